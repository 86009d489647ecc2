"""Queries over whole tables: what lies beyond a former bound is there."""

from loomline.operators import alignment
from loomline.plans.catalogue import QUERIES


def test_verbatim(spark, tmp_path):
    spark.createDataFrame([(1, "x **Gardien** \\- Qui\nva là ?"), (2, "*Un volet*  claque."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, "Gardien - qui va  là ?"), (8, "un volet claque."), (9, "never there"), (10, " ")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.type for r in QUERIES["verbatim_check"](spark, str(tmp_path)).collect()}
    assert set(found) == {(d, i) for d in (1, 2, 3) for i in (7, 8, 9)}
    assert {k for k, v in found.items() if v == "dialogue"} == {(1, 7), (2, 8)}
    assert alignment.verbatim_form("a * b 2*3\n* c") == "a * b 2*3 c"


def test_segment_overlap(spark, tmp_path):
    text = "\n".join(["a" * 99] * 1300)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["segment_overlap"](spark, str(tmp_path)).collect()
    assert {r.match_no for r in found} == set(range(434)) and max(r.e for r in found) == len(text)


def test_active_beat(spark, tmp_path):
    turns = [(1, t, "user", "a" * 1200) for t in range(130)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["active_beat"](spark, str(tmp_path)).collect()
    assert max(r.t for r in found) >= 130 * 100_000 - 30_000 and max(r.pos for r in found) == max(r.pos for r in QUERIES["timeline_beats"](spark, str(tmp_path)).collect())


def test_anchored_alignment(spark, tmp_path):
    lines = [f"Line {i:03d} is here, " + chr(97 + i % 26) * 20 + f" and it goes on to its own end {i:03d}." for i in range(40)]
    text = "\n".join([*lines, "The short one."])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.pos: r for r in QUERIES["anchored_alignment"](spark, str(tmp_path)).collect()}
    assert [(found[2 * i].s, found[2 * i].confidence) for i in range(40)] == [(text.index(x), "anchored") for x in lines]
    assert (found[80].s, found[80].e, found[80].confidence) == (len(text) - 14, len(text), "exact") and len(found) == 82
    assert {found[2 * i + 1].confidence for i in range(41)} == {"none"}
    assert {r.confidence: r.n for r in QUERIES["match_histogram"](spark, str(tmp_path)).collect() if r.n} == {"exact": 1, "anchored": 40, "none": 41}


def test_scene_slices(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(["ab"] * 250)), (2, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.scene_no): r.chars for r in QUERIES["scene_slices"](spark, str(tmp_path)).collect()}
    assert found == {(1, 1): 2 * 4 - 2, (1, 2): 3 * 4 - 2, (1, 3): 245 * 4 - 2, (2, 1): 3, (2, 2): 3, (2, 3): 3}


def test_prompt_compose(spark, tmp_path):
    text = "A long turn that goes on (softly) far beyond forty characters to its end."
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.spoken for r in QUERIES["prompt_compose"](spark, str(tmp_path)).collect()] == [text.replace("(softly) ", "")]
