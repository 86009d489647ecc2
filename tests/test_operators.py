"""Expected behaviour of single operators on small inputs."""

import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import clean_markdown, label_stem, prompt, spoken_text, srt_time
from loomline.operators import alignment, casting, folds, graph, identity, pages, providers, rendering, segments, timeline
from loomline.sources import books, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_mentions_do_not_chain_by_generic_aliases(spark):
    m = spark.createDataFrame([(1, "Anna Bell", ["the guard", "she"]), (2, "Omar Finch", ["the guard"]), (3, "Lady Rosamund", ["Rosamund"]), (4, "Rosamund", [])], "entry_id long, name string, aliases array<string>")
    keys = identity.mention_keys(m)
    assert "she" not in {r.key for r in keys.collect()}
    generic = identity.generic_keys(m, keys)
    assert [r.key for r in generic.collect()] == ["the guard"]
    edges = identity.exact_edges(keys.join(generic, "key", "left_anti"))
    assert {(r.a, r.b) for r in edges.collect()} == {(4, 3)}
    out = graph.components(m.select(F.col("entry_id").alias("node")), edges)
    assert dict(out.collect()) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_fuzzy_names(spark):
    names = spark.createDataFrame([(1, "margaret hill"), (2, "margaret hil"), (3, "unit 7 alpha"), (4, "unit 8 alpha"), (5, "tom")], "entry_id long, norm string")
    assert {(r.a, r.b) for r in identity.fuzzy_edges(names).collect()} == {(2, 1)}


def test_merge_groups_respect_gender():
    c = [{"id": 1, "keys": ["bob"], "gender": "male"}, {"id": 2, "keys": ["robert"], "gender": "male"}, {"id": 3, "keys": ["ann"], "gender": "female"}]
    assert identity.merged_groups(c, [["Bob", "Robert"], ["Robert", "Ann"], ["nobody"], []]) == {1: 1, 2: 1, 3: 3}


def test_prior_casts(spark):
    schema = "volume string, name string, aliases array<string>, gender string, clip_id string"
    volumes = spark.createDataFrame([
        ("v1", "Ada Stone", ["the captain"], "female", "m1"), ("v1", "Li Wei", [], "male", "m9"), ("v2", "Ada Stone", [], "female", "m2"), ("v3", "Ada Stone", [], "female", None),
        ("v2", "Kit", ["shadow"], "male", "m3"), ("v2", "Lou", ["shadow"], "male", "m4"),
    ], schema)
    people = spark.createDataFrame([("Stone Ada", [], "unknown"), ("Wei Li", [], "unknown"), ("Shadow", [], "male"), ("The Captain", [], "female"), ("the  captain", [], "male")], "name string, aliases array<string>, gender string")
    found = dict(casting.prior_casts(volumes, people).collect())
    assert found == {"Stone Ada": "m2", "Wei Li": "m9", "Shadow": None, "The Captain": "m1", "the  captain": None}


def test_missing_clip_is_an_error(spark):
    speakers = spark.createDataFrame([("A", "c1"), ("B", None)], "speaker string, clip_id string")
    bank = spark.createDataFrame([("c1", "/x.wav")], "clip_id string, clip_path string")
    assert dict(casting.clip_paths(speakers, bank, "c1").select("speaker", "clip_path").collect()) == {"A": "/x.wav", "B": "/x.wav"}
    with pytest.raises(Exception, match="no such clip"):
        casting.clip_paths(speakers, bank.where("false")).collect()


def test_strings(spark):
    assert one(spark, prompt(F.col("d"), F.col("t")), d="Warm, Low", t="Hi.") == '(warm - low) "Hi."'
    assert one(spark, spoken_text(F.col("t")), t="(aside) Go (now) on") == "Go on"
    assert one(spark, spoken_text(F.col("t")), t="(sighs)") == "(sighs)"
    assert one(spark, clean_markdown(F.col("t")), t=r"**A** *b* 2\. ") == "A b 2."
    assert one(spark, label_stem(F.col("t")), t="**ANNA** (off) –") == "anna"
    assert one(spark, srt_time(F.col("t")), t=3_723_004) == "01:02:03,004"


def test_packing_and_fusion(spark):
    short = "A b.  C d."
    assert one(spark, segments.packed_pieces(F.col("t"), 20), t=short) == [short]
    assert one(spark, segments.packed_pieces(F.col("t"), 8), t="Aaa b. Ccc d. Eee f.") == ["Aaa b.", "Ccc d.", "Eee f."]
    beats = spark.createDataFrame([("s", 0, "narration", None, "One."), ("s", 1, "narration", None, "Two."), ("s", 2, "dialogue", "A", "x"), ("s", 3, "dialogue", "A", "y"), ("s", 4, "dialogue", "Unknown", "z"), ("s", 5, "dialogue", "Unknown", "w")], "k string, o int, type string, speaker string, text string")
    assert [r.text for r in folds.fused(beats, "k", "o").orderBy("fused_no").collect()] == ["One. Two.", "x y", "z", "w"]


def test_sessions(spark):
    rows = [("s", i, name, "x" * n) for i, (name, n) in enumerate([("A", 60), ("B", 60), ("C", 1), ("D", 1), ("E", 1), ("A", 500)])]
    beats = spark.createDataFrame(rows, "k string, o int, speaker string, text string")
    assert [r.session_no for r in folds.sessions(beats, "k", "o", 4, 130).orderBy("o").collect()] == [1, 1, 1, 1, 2, 3]


def test_dialogue_runs(spark):
    kinds = "sddcdssd"
    items = spark.createDataFrame([(0, i, {"s": "staging", "d": "dialogue", "c": "cue"}[k]) for i, k in enumerate(kinds)], "k int, o int, type string")
    runs: dict = {}
    for r in segments.dialogue_runs(items, "k", "o").orderBy("o").collect():
        runs.setdefault(r.run_no, []).append(r.o)
    assert list(runs.values()) == [[1, 2, 4], [7]]


def test_scenario_times(spark):
    chunks = spark.createDataFrame([("s", i, g, i + 1, 2000) for i, g in enumerate("aab")], "scene_id string, pos int, group_id string, line_no int, duration_ms long")
    lines = timeline.line_times(chunks, 250, 1000, 0)
    assert [(r.start_ms, r.end_ms) for r in lines.orderBy("line_no").collect()] == [(0, 2000), (2250, 4250), (5250, 7250)]
    items = spark.createDataFrame([("s", i, k, "t") for i, k in enumerate(["staging", "dialogue", "dialogue", "staging", "cue", "dialogue"])], "scene_id string, item_no int, type string, text string")
    got = [(r.start_ms, r.end_ms) for r in timeline.sync_entries(items, lines).orderBy("item_no").collect()]
    assert got == [(0, 0), (0, 2000), (2250, 4250), (4250, 5250), (4250, 4250), (5250, 7250)]
    lead = timeline.line_times(chunks.where("pos < 2"), 250, 1000, 350)
    assert [(r.start_ms, r.end_ms) for r in lead.orderBy("line_no").collect()] == [(0, 2350), (2600, 4950)]


def test_page_blocks():
    tree = pages.parsed("<h1>T</h1><p>One</p><pre><code class='language-python'>x</code></pre><table><tr><td>a</td></tr></table><figure>f</figure><p>Two")
    assert [pages.kind_of(b) for b in tree.blocks] == ["prose", "prose", "code", "table", "figure", "prose"]
    nested = pages.parsed("<blockquote><p>a</p><p>b</p></blockquote>")
    assert [b["text"] for b in nested.blocks] == ["a b"]
    assert pages.parsed("<p>One<i>two</i> three<br>four <b>five</b>.</p>").blocks[0]["text"] == "One two three four five ."
    assert pages.parsed("<body><!-- no --><script>x</script><p>a</p><p>b</p></body>").nodes == ["a", "b"]
    assert pages.code_language("x language-rust") == "rust"


def test_alignment():
    norm, where = alignment.normal_with_map("İx “q” —  z")
    assert len(norm) == len(where) and where[:2] == [0, 0] and norm.endswith('"q" - z')
    text = "The first line is here. " * 3 + "Some other words that are only once in the text, and go on for a while longer. End."
    shadow = alignment.normal_with_map(text)[0]
    out = alignment.align_chapter([("The first line is here.", None), ("The first line is here.", None), ("never there at all, not a bit", None), ("End.", None)], shadow)
    assert out[0][:2] == (0, 23) and out[1][:2] == (24, 47) and out[2] is None and out[3][2] == "exact"
    assert alignment.wrapped("abcdef", [(1, 3, "x"), (2, 5, "y")]) == 'a<span class="beat" data-beat-id="x">bc</span><span class="beat" data-beat-id="y">de</span>f'


def test_trim():
    rate = 8000
    tone = np.sin(np.arange(rate) / 5)[:, None] * 0.5
    quiet = np.zeros((2 * rate, 1))
    a, b = rendering.trim_edges(np.concatenate([quiet, tone, quiet]), rate)
    assert abs((b - a) / rate - 1.2) < 0.03
    assert rendering.trim_edges(quiet, rate) == (0, 2 * rate)
    again = np.concatenate([quiet, tone, quiet])[a:b]
    assert rendering.trim_edges(again, rate) == (0, len(again))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(b"\0\0" * rate)
    assert rendering.wave_ms(out.getvalue()) == 1000 and rendering.wave_ms(b"no") == 0


def test_providers(spark):
    assert providers.salvage('{"cast": [{"name": "A"}, {"name": "B', "cast") == [{"name": "A"}]
    assert providers.extract_json('Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    rows = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    none = spark.createDataFrame([], "cache_key string, answer string")
    out, new = providers.answered(rows, "prompt", "s", "m", providers.rule_based_cue, none)
    assert out.count() == 3 and new.count() == 2
    bad = new.withColumn("answer", F.lit("{not json"))
    assert providers.answered(rows, "prompt", "s", "m", providers.rule_based_cue, bad)[1].count() == 2
    assert providers.answered(rows, "prompt", "s", "m", providers.rule_based_cue, new)[1].count() == 0


def test_render_plan(spark):
    long = "(calm) \"" + "word " * 50 + "end\""
    beats = spark.createDataFrame([("b0", 0, "(calm) \"hi\"", "v", 1000), ("b1", 1, "(calm) \"hi\"", "v", 1000), ("b2", 2, long, "v", 40000)], "beat_id string, pos int, prompt string, ref string, duration_ms long")
    renders, chunks = rendering.render_plan(beats, "ref", "m")
    assert {r.beat_id: r.n_beats for r in renders.collect()} == {"b0": 2, "b2": 1}
    texts = [r.text for r in chunks.where("cache_key = '%s'" % renders.where("beat_id = 'b2'").first().cache_key).orderBy("chunk_no").collect()]
    assert len(texts) == 3 and all(t.startswith('(calm) "') and t.endswith('"') for t in texts)
    assert sum(len(t.split()) - 1 for t in texts) == 51


def test_sources(spark, tmp_path):
    (tmp_path / "02-b.txt").write_text("Title\n\nBody text ")
    (tmp_path / "03-c.txt").write_text("   \n")
    assert [tuple(r) for r in files.folder_chapters(spark, str(tmp_path)).collect()] == [("02", "Title", "Body text")]
    from loomline.streaming import ingest_available

    for _ in range(2):
        ingest_available(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="c" href="i/cover.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>x</p>")
    (tmp_path / "b.epub").write_bytes(book.getvalue())
    row = books.epub_table(spark, str(tmp_path)).first()
    assert (row.title, row.cover, row.spine) == ("T", "O/i/cover.png", ["a"])
    changed = books.repacked(book.getvalue(), {"O/a.xhtml": b"<p>y</p>"})
    assert zipfile.ZipFile(io.BytesIO(changed)).read("O/a.xhtml") == b"<p>y</p>"
    volumes = spark.createDataFrame([("s/v1",), ("s/v2",), ("t/v0",), ("flat",)], "book_id string")
    assert [r.leaf for r in books.prior_volumes(volumes, "s/v2").collect()] == ["v1"] and not books.prior_volumes(volumes, "flat").count()


def test_image_order(spark):
    cover = spark.createDataFrame([("i/c.png",)], "href string")
    refs = spark.createDataFrame([(0, 0, "../i/b.png"), (1, 0, "x/a.png")], "spine_idx int, ref_no int, ref string")
    manifest = spark.createDataFrame([(0, "i/a.png"), (1, "i/b.png"), (2, "i/c.png"), (3, "i/d.png")], "item_no int, href string")
    assert [r.href for r in books.image_order(cover, refs, manifest).orderBy("position").collect()] == ["i/c.png", "i/b.png", "i/a.png", "i/d.png"]
