"""Byte-level BPE, encoded by backtracking and decoded by an offset table.

A text is cut at added tokens, then into pretokens. Each pretoken's bytes run once through an Aho-Corasick automaton of the
vocabulary, which gives the longest token from each byte. The encoder takes longest tokens from left to right. A token may stand
after another only if the merges of their joined bytes leave the border between them alone: such pairs are compatible, and a
sequence of compatible neighbours is what the merges make of the whole. If no prefix of the longest token fits, the encoder
steps back over its last token and notes that this byte can't begin a token, so that no byte is tried twice and the work is
linear. Answers about pairs, and codes of usual pretokens, are kept in tables of bounded size.

Ids come as little-endian unsigned 32-bit integers. Decoding gathers bytes by id from one buffer with an offset table.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkloom.llm.shingle import slabs

#: Entries of the tables of pairs and of pretokens; pretokens of more bytes are not kept.
PAIRS, PRETOKENS, KEPT_BYTES = 1 << 20, 1 << 19, 64
#: Bytes of text that are decoded at once.
SLAB = 1 << 22
#: Fixed value: the pretokens of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_END = 1 << 62


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the other bytes in order from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and tables of one tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normalizer, prefix space and dropout is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to be plain strings")
        as_byte = printable_bytes()
        self.of = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rule: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left part, right part, rank
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(as_byte[c] for c in x) for x in (a, b))
            token = self.of[left + right]
            if token in self.parts:
                raise ValueError(f"two merges make token {token}")
            self.rule[self.of[left], self.of[right]] = rank
            self.parts[token] = (self.of[left], self.of[right], rank)
        if any(bytes([b]) not in self.of for b in range(256)):
            raise ValueError("every byte has to be a token")
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # tokens that merges of their own bytes never give can't be in a result
        whole = {t for t, (a, b, rank) in self.parts.items() if self.compatible(a, b, rank)} | {self.of[bytes([b])] for b in range(256)}
        self.shorter: dict[int, int] = {}  # token -> the longest other token that it begins with, or -1
        self.length = {}
        usable = {x: t for x, t in self.of.items() if t in whole}
        for x, t in usable.items():
            self.length[t] = len(x)
            self.shorter[t] = next((usable[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in usable), -1)
        self.usable = usable
        self._automaton = None
        size = max([*self.of.values(), *self.added.values(), -1]) + 1
        strings = [b""] * size
        for x, t in [*self.of.items(), *((c.encode(), t) for c, t in self.added.items())]:
            strings[t] = x
        #: The offset table: token t is bytes[offsets[t]:offsets[t + 1]].
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in strings]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.codes = _Codes(self)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that have stood at a token's left (0) or right (1) edge while it was merged: (piece, rank at which it went into the next)."""
        got = self.edges.get((token, side))
        if got is None:
            if token in self.parts:
                inner, rank = self.parts[token][side], self.parts[token][2]
                got = [*self.edge(inner, side)[:-1], (inner, rank), (token, _END)]
            else:
                got = [(token, _END)]
            self.edges[token, side] = got
        return got

    def compatible(self, a: int, b: int, before: int = _END) -> bool:
        """True if no merge of a rank below before joins pieces across the border of a and b: while two pieces face each other
        there, their own rule would have to come before each of them goes into a larger one (of equal ranks, the left merge is first)."""
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = left[i], right[j]
            rank = self.rule.get((x, y))
            if rank is not None and rank < before and rank < x_goes and rank <= y_goes:
                return False
            if x_goes == y_goes == _END:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def may_follow(self, a: int, b: int) -> bool:
        """compatible(a, b), from the table of pairs."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.compatible(a, b)
        return got

    def longest(self, raw: bytes) -> list[int]:
        """From each byte on the longest token, by one run of the automaton (matches come by their ends, so the last one stays)."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for x, t in self.usable.items():
                self._automaton.add_word(x.decode("latin-1"), (len(x) - 1, t))
            self._automaton.make_automaton()
        out = [-1] * len(raw)
        for end, (back, t) in self._automaton.iter(raw.decode("latin-1")):
            out[end - back] = t
        return out

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of the bytes of one pretoken."""
        if raw in self.usable:
            return [self.usable[raw]]
        longest, out, at = self.longest(raw), [], 0
        dead = bytearray(len(raw) + 1)
        token = longest[0] if raw else -1
        while at < len(raw):
            while token >= 0 and (dead[at + self.length[token]] or out and not self.may_follow(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < len(raw) else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        find = _pattern().findall
        if self.added and any(c in text for c in self.added):
            out = []
            for piece in _added(tuple(self.added)).split(text):
                if piece in self.added:
                    out.append(np.uint32(self.added[piece]).tobytes())
                else:
                    out += map(self.codes.__getitem__, find(piece))
            return b"".join(out)
        return b"".join(map(self.codes.__getitem__, find(text)))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of ids, and the offset of each id's first one. Ids outside the vocabulary have no bytes."""
        ids = ids.astype(np.int64)
        ids = np.where(ids < len(self.offsets) - 1, ids, 0), ids < len(self.offsets) - 1
        n = (self.offsets[ids[0] + 1] - self.offsets[ids[0]]) * ids[1]
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids[0]] - (ends - n), n)
        return self.bytes[take], np.concatenate(([0], ends))


class _Codes(dict):
    """Pretoken -> packed ids; the usual ones are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pretoken: str) -> bytes:
        raw = pretoken.encode()
        out = np.array(self.vocabulary.encode_bytes(raw), np.uint32).tobytes()
        if len(raw) <= KEPT_BYTES:
            if len(self) >= PRETOKENS:
                self.clear()
            self[pretoken] = out
        return out


_MADE: dict = {}


def _pattern():
    if "pattern" not in _MADE:
        import regex

        _MADE["pattern"] = regex.compile(PATTERN)
    return _MADE["pattern"]


def _added(strings: tuple):
    if strings not in _MADE:
        import re

        _MADE[strings] = re.compile("(" + "|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True)) + ")")
    return _MADE[strings]


def vocabulary(text: str) -> Vocabulary:
    """The tables of a tokenizer file, made once in each Python worker."""
    key = hashlib.sha256(text.encode()).digest()
    if key not in _MADE:
        _MADE[key] = Vocabulary(text)
    return _MADE[key]


def _shared(df: DataFrame, path: str):
    """The file's text (1.5 MB for 50,000 tokens; its size doesn't depend on the data), read by the driver: executors need not have it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    vocabulary(text)  # a file that doesn't fit is an error here
    return df.sparkSession.sparkContext.broadcast(text)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: packed ids of the text (binary; 4 bytes an id). Null and empty texts have no ids. Repeated rows stay rows;
    a column of the name ids_col is replaced; a text is encoded whole, whatever its length. Memory follows the longest text."""
    df = df.drop(ids_col)
    shared, schema = _shared(df, path), df.schema
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col}")

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            ids = [vocab.encode(t) if t else b"" for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, ids_col])

    return df.mapInArrow(run, StructType([*schema.fields]).add(ids_col, "binary"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text of the packed ids. Bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing;
    null ids give an empty text."""
    df = df.drop(text_col)
    shared, schema = _shared(df, path), df.schema

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            packed, out = [x or b"" for x in batch.column(ids_col).to_pylist()], []
            for a, b in slabs(packed, SLAB):
                flat, start = vocab.decode(np.frombuffer(b"".join(x[: len(x) // 4 * 4] for x in packed[a:b]), "<u4"))
                cut = start[np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed[a:b]])))]
                raw = flat.tobytes()
                out += [raw[i:j].decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text_col])

    return df.mapInArrow(run, StructType([*schema.fields]).add(text_col, "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of docs: from the ids that encode() gives and the text
    that decode() makes of them."""
    back = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
