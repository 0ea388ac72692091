"""Chat formatting with Spark expressions only.

Template: a turn block is <|start|>role<|body|>text<|next|>text...<|end|> and a line feed; adjacent turns of one role share a
block. In texts and roles a backslash is put behind the first character of every control string (those four and <s>, </s>,
[INST], [/INST], with however many backslashes there are already), so that none is left; taking one away restores the text.

A conversation is collected in chunks of CHUNK turn numbers, then its chunks are joined: no task sorts more than the turns
of a chunk at once. The output of one conversation is one string, which has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the template's control strings
START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>"
_TAIL = r"(\|(?:start|body|next|end)\|>|/?s>|/?INST\])"
_PUT = r"([<\[])(\\*)" + _TAIL
_TAKE = r"([<\[])\\(\\*)" + _TAIL
CHUNK = 64


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped(x: str) -> str:
    """SQL for a text without control strings."""
    return f"regexp_replace({x}, {_sql(_PUT)}, {_sql('$1' + chr(92) * 2 + '$2$3')})"


def unescaped(x: str) -> str:
    """SQL for the text that escaped() was given."""
    return f"regexp_replace({x}, {_sql(_TAKE)}, '$1$2$3')"


def _cut(x: str, at: str) -> str:
    return f"split({x}, {_sql(''.join(chr(92) + c if c in '|<>' else c for c in at))}, -1)"


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; loss_spans are (start, length) in code points, from 0, of
    each assistant text in formatted, as escaped there.

    Null texts and roles are empty ones. Turns go by number, nulls first; equal numbers by role, then text. Repeated rows
    each count. Rows with a null conversation form one conversation. An empty table gives none. Other columns aren't read.
    """
    t = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chunks = t.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chunks = chunks.withColumn(
        "blocks",
        F.expr("""aggregate(turns, cast(array() as array<struct<role: string, texts: array<string>>>), (done, t) ->
            if(size(done) > 0 and element_at(done, -1).role = t.role,
               concat(slice(done, 1, size(done) - 1), array(named_struct('role', t.role, 'texts', concat(element_at(done, -1).texts, array(t.text))))),
               concat(done, array(named_struct('role', t.role, 'texts', array(t.text))))))"""),
    )
    head = f"concat('{START}', {escaped('b.role')}, '{BODY}')"
    chunks = chunks.selectExpr(
        "conv_id",
        f"""named_struct('chunk', chunk, 'first', blocks[0].role, 'last', element_at(blocks, -1).role, 'head', length(element_at(transform(slice(blocks, 1, 1), b -> {head}), 1)),
            'body', array_join(transform(blocks, b -> concat({head}, array_join(transform(b.texts, x -> {escaped("x")}), '{NEXT}'))), '{END}\\n')) as part""",
    )
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.selectExpr(
        "conv_id",
        f"""concat(array_join(transform(parts, (p, i) -> if(i = 0, p.body, if(parts[i - 1].last = p.first, concat('{NEXT}', substring(p.body, p.head + 1)), concat('{END}\\n', p.body)))), ''), '{END}\\n') as formatted""",
    )
    segments = f"""flatten(transform({_blocks("formatted")}, (b, i) -> transform({_cut(_body("b"), NEXT)}, (x, j) -> named_struct(
        'skip', if(j > 0, {len(NEXT)}, length({_head("b")}) + {len(BODY)} + if(i > 0, {len(END) + 1}, 0)), 'n', length(x), 'loss', substring({_head("b")}, {len(START) + 1}) = 'assistant'))))"""
    return whole.selectExpr(
        "conv_id",
        "formatted",
        f"""aggregate({segments}, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, length: int>>)),
            (a, s) -> named_struct('at', a.at + s.skip + s.n, 'spans', if(s.loss, concat(a.spans, array(named_struct('start', a.at + s.skip, 'length', s.n))), a.spans)), a -> a.spans) as loss_spans""",
    )


def _blocks(x: str) -> str:
    """Blocks of a formatted conversation, without their ends."""
    return f"filter({_cut(x, END + chr(10))}, b -> b <> '')"


def _head(b: str) -> str:
    return f"substring_index({b}, '{BODY}', 1)"


def _body(b: str) -> str:
    return f"substring({b}, length({_head(b)}) + {len(BODY) + 1})"


def read_turns(formatted: str = "formatted") -> str:
    """SQL for the turns (role, text) of a formatted conversation."""
    role = unescaped(f"substring({_head('b')}, {len(START) + 1})")
    return f"flatten(transform({_blocks(formatted)}, b -> transform({_cut(_body('b'), NEXT)}, x -> named_struct('role', {role}, 'text', {unescaped('x')}))))"


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> str:
    """SQL for the text under the loss mask."""
    return f"array_join(transform({spans}, s -> {unescaped(f'substring({formatted}, s.start + 1, s.length)')}), '')"


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from it."""
    read = chats.selectExpr("conv_id", "formatted", f"{read_turns()} as turns", f"{read_loss()} as loss")
    return read.selectExpr("conv_id", "cast(size(turns) as long) as n_turns", r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256) as turns_sha256", "cast(length(loss) as long) as loss_chars", "sha2(loss, 256) as loss_sha256", "cast(length(formatted) as long) as formatted_chars")


#: The digests in DuckDB's SQL. Lengths: start 9, body 8, next 8, end 7 and a line feed.
DIGESTS_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, regexp_replace(text, '([<\[])(\\*)(\|(?:start|body|next|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') as et,
      regexp_replace(role, '([<\[])(\\*)(\|(?:start|body|next|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') as er,
      lag(role) over (partition by conv_id order by turn nulls first, role, text) is not distinct from role and row_number() over (partition by conv_id order by turn nulls first, role, text) > 1 as same from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(et) + case when same then 8 else 25 + length(er) end)::bigint as formatted_chars
from e group by conv_id"""
