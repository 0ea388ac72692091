"""What larger and odder tables showed: titles, loud samples, alignment and folds in bulk, draws, counts of readings."""

import hashlib
import os
import re

import pyarrow.parquet as pq
import pytest

from talkloom.functions import digests
from talkloom.plans import artifacts, catalog, exports, kernels, meetings, more, owners, scoring, speech  # noqa: F401
from tests.test_catalog import TABLES, D, compare


def tables(tmp_path, **own):
    """The smallest tables, some of them replaced."""
    for t in TABLES:
        if t in own:
            pq.write_table(own[t].toArrow(), tmp_path / f"{t}.parquet")
        else:
            os.symlink(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def against_sql(spark, d, *names):
    for name in names:
        compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], d)


def test_names_keep_entities_that_the_sql_does_not_know(spark, tmp_path):
    titles = ["a&amp;b", "cut &amp", "&eacute;&lt;b&gt;", "&amp;lt;", "&#39;x&#x27;", "&quot;q&quot; ` r", ""]
    pages = spark.createDataFrame([(i, "u", f"<html><title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string")
    against_sql(spark, tables(tmp_path, pages=pages), "name_clean")


def test_samples_louder_than_16_bits(spark, tmp_path):
    """Values of 560 are 33,600 of 32,768; two windows whose loudness differs by less than 1e-9 are equally loud, and the first counts."""
    value = lambda u, i: 9_000 * (1 + u) / 60 if i % 11 == 3 else 546.75 if i == 40 else (i * 37 + u) % 50 / 60
    rows = [(u * 1000 + i, u, value(u, i)) for u in range(4) for i in range(70 + u)]
    rows += [(9000 + i, 9, 16_000 / 60 if i in (14, 22) else 1 / 60 if i == 23 else 0.0) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "cast(timestamp_seconds(1700000000 + event_id) as timestamp_ntz) as ts", "user_id", "'view' as event_type", "value", "'{}' as props")
    against_sql(spark, tables(tmp_path, events=e), "wav_slice_rms", "wav_loudest_windows")


def plan(spark, name):
    return catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_next_anchor_without_frames_to_the_end_of_a_recording(spark):
    """Such a frame is gone through again for every word. One pass: nothing before it is made twice."""
    p = plan(spark, "sequence_align_attribution")
    assert "currentrow$(), unboundedfollowing$()" not in p and p.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["speaker_accuracy", "segment_owner", "column_build", "built_witness_error", "consecutive_duplicate_drop", "llm_windows", "window_prompts", "near_miss_terms", "canonical_cues"])
def test_small_groups_come_many_in_a_batch(spark, name):
    assert "GroupsInPandas" not in plan(spark, name) and "currentrow$(), unboundedfollowing$()" not in plan(spark, name)


def test_draws_are_hashed_in_bulk(spark):
    for name in ("paired_block_bootstrap", "pooled_block_bootstrap", "wording_report"):
        assert "md5(" not in plan(spark, name)
    heads, tails = ["-12|", "9223372036854775807|3|"], [str(i) for i in (0, 7, 42, 1249, 123456)]
    words = digests.md5_words(heads, digests.endings(tails))
    want = [hashlib.md5((h + t).encode()).hexdigest() for h in heads for t in tails]
    assert ["".join(f"{int(w[i]):08x}" for w in words) for i in range(len(want))] == want
    with pytest.raises(ValueError):
        digests.md5_words(["x" * 50], digests.endings(["123456"]))


def test_readings_are_judged_once(spark):
    x = spark.createDataFrame([("ano", "ano", None, "anos")] * 9 + [("ten", "tn", "ten", "ten")] * 4, "c string, a0 string, a1 string, b string")
    assert scoring.readings(x).count() == 2
    for f in (scoring.errors, scoring.control, scoring.departures, scoring.bad_pairs, scoring.buckets):
        assert sorted(map(repr, f(scoring.readings(x)).collect())) == sorted(map(repr, f(scoring.judged(x)).collect()))
    for name in ("witness_error", "control_error", "leave_one_out", "merge_buckets"):
        assert plan(spark, name).rindex("HashAggregate") > plan(spark, name).index("ArrowEvalPython")


def test_secrets_line_by_line(spark, tmp_path):
    texts = ["a  password b\nplain words only\nkey abcdefghij0123456789xyz and 0123456789abcdefghij", "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa 12345678901234567890", "x-abcdefghij0123456789xyz. token", "tokens abcdefghij0123456789!"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    against_sql(spark, tables(tmp_path, documents=docs), "secret_filter")
    assert plan(spark, "secret_filter").count("Generate ") == 1  # lines aren't copied to each of their words


def test_sketch_of_parts_is_kept_for_flags_only(spark):
    assert not re.search(r"keys=\[l_returnflag#\d+, l_partkey#\d+\], functions=\[[^]]*approx", plan(spark, "approximate_distinct"))


def test_only_differing_witnesses_are_summed(spark):
    assert "Union" not in plan(spark, "dq_arms_comparable")


def test_terms_not_pages_are_dealt_out(spark):
    p = catalog.frames(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    joined = p[: p.index("Join Inner, (media_id")]
    assert "regexp_replace(html" not in joined and "regexp_replace(html" in p


def test_no_word_and_no_term_of_prompts_is_dealt_out(spark):
    p = plan(spark, "window_prompts")
    assert not re.search(r"hashpartitioning\([^)]*\b(term|low|word|k|i|s|slot|__b)#", p) and "Exchange hashpartitioning(media_id" in p
