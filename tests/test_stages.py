"""Stages from end to end, with providers that follow simple rules, and readers and writers of files."""

import json
import re
import sys
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from pyspark.cloudpickle import register_pickle_by_value

from loomline import stages
from loomline.functions import accent_code, frames
from loomline.operators import rendering, segments, sync, timeline
from loomline.sources import books, files

register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
CHAPTERS = {
    "01-dawn.txt": 'Dawn\n\nThe lamp was out. Mara looked at the door for a while.\n\n"Is anyone there?" Mara asked.\n\n"Only me," said Tomas.',
    "02-noon.txt": 'Noon\n\nTomas Vale came back, and the rain with him.\n\n"You are late," Mara said.',
}


def mentions(prompt):
    names = [n for n in ("Mara", "Tomas Vale", "Tomas") if n in prompt.split("\n\n", 1)[1]]
    people = [{"name": n, "aliases": ["she"] if n == "Mara" else ["Tomas"], "gender": "female" if n == "Mara" else "male", "approx_age": "adult", "description": f"{n} speaks.", "evidence": n} for n in names]
    return "Here:\n```json\n" + json.dumps({"cast": people}) + "\n```"


def boundaries(prompt):
    last = max(int(n) for n in re.findall(r"^\[(\d+)\]", prompt, re.MULTILINE))
    return json.dumps({"scenes": [{"scene_id": "a", "start_paragraph": 1, "end_paragraph": 1}, {"scene_id": "b", "start_paragraph": 2, "end_paragraph": last}]})


def beats(prompt):
    body = prompt.split("\n\n", 1)[1]
    out = []
    for p in body.split("\n\n"):
        spoken = re.match(r'"([^"]*)"', p)
        who = "TOMAS" if "Tomas" in p else "Mara"
        out.append({"type": "dialogue", "text": spoken[1], "speaker": who, "source_span": p} if spoken else {"type": "narration", "text": p, "source_span": p})
    return json.dumps({"beats": out})


def cues(prompt):
    return json.dumps({"directions": [{"line": 1, "cue": " softly "}]})


def profiles(prompt):
    return json.dumps({"profiles": [{"name": "Mara", "voice_descriptor": "low, warm"}, {"name": "Tomas", "voice_descriptor": "n/a"}]})


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("book")
    for name, text in CHAPTERS.items():
        (folder / name).write_text(text)
    chapters = stages.ingest(spark, str(folder))
    cast = stages.extract_characters(chapters, {"mentions": mentions})
    scenes, found = stages.segment_scenes(chapters, cast, {"boundaries": boundaries, "beats": beats})
    return chapters, cast, scenes, found


def test_characters_and_scenes(book):
    _, cast, scenes, found = book
    assert {r.name: (r.occurrences, r.gender) for r in cast.collect()} == {"Mara": (2, "female"), "Tomas": (2, "male")} or {r.name for r in cast.collect()} == {"Mara", "Tomas Vale"}
    assert {(r.chapter_id, r.scene_no) for r in scenes.collect()} == {("01", 1), ("01", 2), ("02", 1), ("02", 2)}
    rows = found.orderBy("chapter_id", "scene_no", "pos").collect()
    assert [r.type for r in rows] == ["narration", "dialogue", "dialogue", "narration", "dialogue"] and rows[2].speaker in ("Tomas", "Tomas Vale")


def test_direction_rendering_and_sync(spark, book, tmp_path):
    chapters, cast, _, found = book
    clips = spark.createDataFrame([("f1", "/f1.wav", "female", "adult", "england"), ("m1", "/m1.wav", "male", "adult", "us")], "clip_id string, clip_path string, gender string, age_band string, accent string")
    none = spark.createDataFrame([], "volume string, name string, aliases array<string>, gender string, clip_id string")
    targets = cast.select("name", "gender", F.lit("adult").alias("age_band"), F.lit("any").alias("accent"))
    told = spark.createDataFrame([], "name string, voice_descriptor string")
    book_cast = stages.cast_voices(cast, clips, none, targets, told)
    tiers = {r.name: (r.clip_id, r.tier) for r in book_cast.collect()}
    assert tiers["Narrator"] == ("f1", "narrator") and tiers["Mara"] == ("f1", "ranked") and len(tiers) == 3
    chosen = {r.name: r for r in stages.cast_voices(cast, clips, none, targets, told, "m1").collect()}
    assert (chosen["Narrator"].clip_id, chosen["Narrator"].tier) == ("m1", "override") and chosen["Narrator"].voice_descriptor.startswith("adult, American, male")
    with pytest.raises(ValueError, match="no such clip"):
        stages.cast_voices(cast, clips, none, targets, told, "zz")
    directed, profiles_ = stages.direct(found, cast, clips, book_cast, {"profiles": profiles, "cues": cues})
    voices = {r.name: r.voice_descriptor for r in profiles_.collect()}
    assert voices["Mara"] == "low, warm" and "Narrator" in voices
    rows = directed.orderBy("chapter_id", "scene_id", "pos").collect()
    assert rows[1].prompt == '(low - warm - softly) "Is anyone there?"' and rows[0].speaker == "Narrator"
    renders, chunks = stages.plan_renders(directed, book_cast, clips)
    assert renders.count() == 5 == chunks.count() and {r.ref for r in renders.collect()} == {"/f1.wav", "/m1.wav"}
    texts = chapters.select("chapter_id", F.lit(0).alias("part_no"), F.posexplode(F.split("text", "\n\n")).alias("node_no", "raw"), F.lit("a.xhtml").alias("xhtml"))
    ends = F.sum(F.length("raw") + 1).over(__import__("pyspark").sql.Window.partitionBy("chapter_id").orderBy("node_no")) - 1
    texts = texts.withColumn("e", ends).withColumn("s", F.col("e") - F.length("raw"))
    rendered = directed.withColumn("beat_id", F.concat_ws("_", "scene_id", "pos")).withColumn("duration_ms", F.length("text").cast("long") * 10)
    order = __import__("pyspark").sql.Window.partitionBy("chapter_id").orderBy("scene_id", "pos")
    rendered = rendered.withColumn("pos", F.row_number().over(order).cast("long"))
    nothing = spark.createDataFrame([], "chapter_id string, kind string")
    matched, manifest, lost = stages.sync_text(rendered, texts, nothing, nothing, "a/b")
    assert {r.confidence for r in matched.collect()} == {"span-exact"} and lost.count() == 0
    assert sorted(r.section for r in manifest.collect()) == ["beat"] * 5 + ["head"]
    assert json.loads(manifest.where("section = 'head'").first().item)["matched"] == 5
    items, timings = stages.mix(rendered.withColumn("book_id", F.lit("b")), spark.createDataFrame([("01", "Dawn")], "chapter_id string, title string"))
    assert [(r.title, r.start_ms) for r in timings.orderBy("chapter_id").collect()][0] == ("Dawn", 0) and items.where("kind = 'beat'").count() == 5


def test_lecture(spark):
    chapters = spark.createDataFrame([("01", "\n\n".join(f"Paragraph {i}." for i in range(60)))], "chapter_id string, text string")
    assert stages.lecture(chapters).count() == 60

    def spoken(prompt):
        if "[0] Paragraph 25." in prompt:
            return "no"
        return json.dumps({"beats": [{"index": 1, "text": " One. "}, {"index": 2, "text": " "}]})

    rows = {r.pos: r.text for r in stages.lecture(chapters, {"normalise": spoken}).collect()}
    assert len(rows) == 60 and rows[1] == "One." and rows[2] == "Paragraph 2." and rows[26] == "Paragraph 26." and rows[51] == "One."


def test_scenario(spark, tmp_path):
    (tmp_path / "play.md").write_text("A play.\n**Personnages**\nANNA, a baker\nBO\n# 1. The shop\nANNA: Good morning.\nBO: Hello.\n**2**\nTOUS: Come in!\n")

    def structure(prompt):
        lines = [x for x in prompt.split("\n\n", 1)[1].splitlines() if ":" in x]
        found = [{"type": "dialogue", "speaker": x.split(":")[0], "text": x.split(":", 1)[1]} for x in lines]
        return json.dumps({"items": [*found, {"type": "dialogue", "speaker": "BO", "text": "made up"}]})

    roster = lambda p: '{"entries": [{"name": "Anna (she)", "description": "a baker"}]}'
    items, speakers = stages.ingest_scenario(spark, str(tmp_path), {"structure": structure, "roster": roster})
    rows = items.orderBy("section_no", "item_no").collect()
    assert [(r.type, r.speaker, r.text) for r in rows] == [("dialogue", "ANNA", "Good morning."), ("dialogue", "BO", "Hello."), ("staging", "", "made up"), ("dialogue", "TOUS", "Come in!"), ("staging", "", "made up")]
    assert [(r.speaker, r.bio) for r in speakers.orderBy("place").collect()] == [("ANNA", "a baker"), ("BO", "")]
    entries, srt = stages.sync_scenario(
        spark.createDataFrame([("s", 0, "staging", "x"), ("s", 1, "dialogue", "y")], "scene_id string, item_no int, type string, text string"),
        spark.createDataFrame([("s", 1, "g", 1, 2000)], "scene_id string, pos int, group_id string, line_no int, duration_ms long"),
    )
    assert [(r.start_ms, r.end_ms) for r in entries.orderBy("item_no").collect()] == [(0, 0), (0, 2350)] and "00:00:00,000 --> 00:00:01,500" in srt.where("n = 1").first().block


@pytest.fixture(scope="module")
def epub(tmp_path_factory):
    folder = tmp_path_factory.mktemp("epub")
    pages = {"cover": "<p>C</p>", "chapter1": "<h1>One</h1><p>A.</p><pre>x = 1</pre><p>B.</p>", "chapter1_1": "<p>C.</p><table><tr><td>t</td></tr></table>", "chapter2": "<p>D.</p>", "toc": "<h1>Contents</h1><p>x</p>"}
    manifest = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="x"/>' for n in pages)
    spine = "".join(f'<itemref idref="{n}"/>' for n in pages)
    with zipfile.ZipFile(folder / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>')
        for n, body in pages.items():
            z.writestr(f"O/{n}.xhtml", f"<html><body>{body}</body></html>")
    return str(folder)


def test_epubs(spark, epub, tmp_path):
    found = stages.ingest_epub(spark, epub).orderBy("chapter_no").collect()
    assert [(r.chapter_id, r.title, r.parts, r.text) for r in found] == [("01", "One", "chapter1,chapter1_1", "A.\n\nB.\n\nC."), ("02", "Chapter2", "chapter2", "D.")]
    chapters, elements = stages.ingest_lecture_epub(spark, epub)
    assert {r.text for r in chapters.collect()} >= {"A.\n\nB.", "C.", "D."} and not chapters.where("title = 'Contents'").count()
    assert {(r.kind, r.after_paragraph) for r in elements.collect()} == {("code", 0), ("table", 0)}
    n = files.write_chapter_texts(stages.ingest_epub(spark, epub), str(tmp_path / "out"), {"title": "T"})
    assert n == 2 and (tmp_path / "out/01-one.txt").read_text() == "One\n\nA.\n\nB.\n\nC." and json.loads((tmp_path / "out/.meta.json").read_text()) == {"title": "T"}
    paths = spark.createDataFrame([(str(tmp_path / "out/01-one.txt"),), (str(tmp_path / "none"),)], "path string")
    assert files.deleted(paths) == 1 and (tmp_path / "out/01-one.txt").exists()
    assert files.deleted(paths, dry_run=False) == 1 and not (tmp_path / "out/01-one.txt").exists()
    assert [r.stem for r in books.epub_pages(spark, epub).orderBy("spine_idx").collect()] == ["cover", "chapter1", "chapter1_1", "chapter2", "toc"]


def test_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    (tmp_path / "b.wav").write_bytes(b"no")
    found = {r.path.rsplit("/", 1)[1]: r.duration_ms for r in files.sound_durations(spark, str(tmp_path)).collect()}
    assert found == {"a.wav": 500, "b.wav": 0} and files.newest_file(spark, str(tmp_path), "*.wav").endswith(".wav")
    (tmp_path / "validated.tsv").write_text("client_id\tpath\tsentence\tup_votes\tdown_votes\tage\tgender\taccents\n" + "c\tp\tIt is \"so\".\t3\t0\ttwenties\tfemale_feminine\tEngland English|x\n")
    rows = files.read_utterances(spark, files.best_existing(spark, str(tmp_path))).withColumns({"row_no": F.lit(1).cast("long"), "length_ms": F.lit(12500).cast("long")})
    seeded = stages.seed_voices(rows).first()
    assert (seeded.gender, seeded.age_band, seeded.accent, seeded.sentences) == ("female", "young_adult", "england", ['It is "so".'])
    (tmp_path / "c").mkdir()
    for i in (1, 2):
        (tmp_path / "c" / f"0{i}.json").write_text(json.dumps({"chapter_id": f"0{i}", "n": i}, indent=2))
    assert [r.n for r in files.stage_artifacts(spark, str(tmp_path / "c"), "chapter_id string, n long", "02").collect()] == [2]


def test_settings():
    s = stages.Settings.from_env({"LOOMLINE_INTRA_MS": "300", "LOOMLINE_LLM__CONTEXT": "10", "CONTEXT": "20", "MODEL_NAME": "m", "OTHER": "x"})
    assert (s.intra_ms, s.llm_context, s.model, s.separator) == (300, 10, "m", "\n\n")


def test_small_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(segments.preview(F.lit("a" * 50), 10)) == "a" * 5 + " […] " + "a" * 5 and value(segments.preview(F.lit("abc"), 10)) == "abc"
    assert [value(frames(F.lit(x))) for x in (0.0, 0.02, 1.0, 3.3)] == [1, 1, 33, 89]
    assert [value(accent_code(F.lit(x), {"a b": "ab"})) for x in ("A b|c", "z", "")] == ["ab", "other", "any"]
    marks = sync.triggered(spark.createDataFrame([("b1", "s"), (None, "t")], "before_beat string, src string"), spark.createDataFrame([("b1", 700)], "beat_id string, start_ms long"))
    assert {r.src: r.trigger_ms for r in marks.collect()} == {"s": 700, "t": None}
    both = sync.visual_elements(spark.createDataFrame([("i",)], "src string"), spark.createDataFrame([("code", "x")], "kind string, html string"))
    assert {(r.kind, r.src, r.html) for r in both.collect()} == {("image", "i", None), ("code", None, "x")}
    import numpy as np

    a, b = np.ones((100, 1)), np.zeros((100, 2))
    assert rendering.joined([a, b], 1000, 50).shape == (150, 2) and rendering.reference_audio(np.full((3, 1), 0.5), 10, 1.0).shape == (10, 1)
    work = rendering.sorted_for_shapes(spark.createDataFrame([(3,), (1,), (2,)], "n_frames int"))
    assert sorted(r.n_frames for r in work.collect()) == [1, 2, 3]
    newest = rendering.newest(spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "key string, path string, modified int"), "key")
    assert newest.first().path == "b"
    heavy = spark.createDataFrame([("c", "male", 1, 1), ("c", "female", 2, 5), ("c", "male", 3, 2)], "k string, v string, o int, w int")
    from loomline.operators import identity

    assert identity.majority(heavy, "k", "v", "o", weight="w").first().v == "female" and identity.majority(heavy, "k", "v", "o").first().v == "male"
    spans = spark.createDataFrame([("c", 1, 0, 1000, 2000), ("c", 2, 1, 2000, 3000), ("c", 3, 2, 10000, 11000)], "k string, pos long, source_paragraph int, start_ms long, end_ms long")
    marks = spark.createDataFrame([("c", 0, 1), ("c", 1, -1), ("c", 2, 99)], "k string, element_no long, after_paragraph int")
    got = {r.element_no: (r.after_pos, r.before_pos, r.trigger_ms) for r in timeline.visual_placement(marks, spans, "k").collect()}
    assert got == {0: (2, 3, 10000), 1: (None, 1, 0), 2: (3, None, 11000)}
