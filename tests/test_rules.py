"""Rules of the operators on small inputs, and the alignment ladder against a plain version of its rules."""

import difflib
import itertools
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomline.operators import alignment, characters, contracts, finishing, folds, guards, identity, pages, providers, scripts, segments
from loomline.plans.alignment_queries import ladder_rows
from loomline.plans.registry import table


def plain_ladder(beats, shadow):
    """The rules word for word: neighbours by scanning, common runs by difflib."""

    def common(part, needle):
        m = difflib.SequenceMatcher(None, needle, part, autojunk=False).find_longest_match(0, len(needle), 0, len(part))
        return (m.b, m.b + m.size, "fuzzy") if m.size >= max(20, int(0.2 * len(needle))) else None

    def strict(needle, text, begin, end):
        if len(needle) <= 60:
            x = text.find(needle, begin, end)
            return (x, x + len(needle), "exact") if x >= 0 else None
        h = text.find(needle[:30], begin, end)
        t = text.find(needle[-30:], h + 30, h + max(2 * len(needle) + 300, 1000)) if h >= 0 else -1
        return (h, t + 30, "anchored") if t >= 0 else None

    def loose(needle, part):
        if found := strict(needle, part, 0, len(part)):
            return found
        if len(needle) > 60:
            if (h := part.find(needle[:30])) >= 0:
                return h, h + 30, "head-only"
            if (t := part.find(needle[-30:])) >= 0:
                return t, t + 30, "tail-only"
        return common(part[: max(3000, 4 * len(needle))], needle) or common(part, needle)

    norm = [tuple(alignment.normal_with_map(x or "")[0].strip() for x in b) for b in beats]
    out, cursor = [None] * len(beats), 0
    for i, (text, span) in enumerate(norm):
        x = shadow.find(span, cursor, cursor + 8000) if span else -1
        found = (x, x + len(span), "span-exact") if x >= 0 else strict(text, shadow, cursor, cursor + 8000) if text else None
        if found:
            out[i], cursor = found, found[1]
    for _ in range(3):
        new = 0
        for i, (text, span) in enumerate(norm):
            if out[i]:
                continue
            before = next((out[j][1] for j in reversed(range(i)) if out[j]), 0)
            after = next((out[j][0] for j in range(i + 1, len(out)) if out[j]), len(shadow))
            begin = max(0, before - 2000)
            part = shadow[begin:after] if after > begin else ""
            x = part.find(span) if span and part else -1
            found = (x, x + len(span), "span-exact") if x >= 0 else loose(text, part) if text and part else None
            if found:
                out[i], new = (begin + found[0], begin + found[1], found[2] + "+pass2"), new + 1
        if not new:
            break
    return out


def test_ladder_against_plain_rules(spark):
    rows = ladder_rows(table(spark, SMALL, "documents"))
    found = {(r.doc_id, r.pos): (r.s, r.e, r.confidence) for r in alignment.aligned(rows).collect()}
    n = 0
    for r in rows.where("length(text) < 20000").collect():
        want = plain_ladder([(b.text, b.source_span) for b in r.beats], alignment.normal_with_map(r.text)[0])
        for b, m in zip(r.beats, want, strict=True):
            assert found[r.doc_id, b.pos] == (m or (None, None, "none"))
            n += 1
    assert n > 1000


def test_chapters_may_be_named_by_texts(spark):
    rows = spark.createDataFrame([("c1", "One line here.", [(0, "one  line", None)])], "chapter_id string, text string, beats array<struct<pos:long,text:string,source_span:string>>")
    assert [tuple(r) for r in alignment.aligned(rows, "chapter_id").collect()] == [("c1", 0, 0, 8, "exact")]
    assert [tuple(r) for r in alignment.anchored_matches(rows, "chapter_id").collect()] == [("c1", 0, 0, 8, "exact")]


def test_ladder_on_random_texts():
    rng = random.Random(4)
    for _ in range(60):
        words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(50, 900))]
        text = " ".join(words)
        beats = []
        for _ in range(25):
            a = rng.randrange(len(words))
            piece = words[a : a + rng.randint(2, 60)]
            span = " ".join(piece) if rng.random() < 0.3 else None
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                piece[rng.randrange(len(piece))] = "zz"
            beats.append((" ".join(piece), span))
        assert alignment.align_chapter(beats, text) == plain_ladder(beats, text)


def test_only_what_was_seen_is_claimed():
    head, tail = "a head of thirty characters ok ", "and thirty characters of a tail"
    beat = head + "in between there was something else altogether " + tail
    assert alignment.lenient(beat, f"xx {head}yy", 0) == (3, 33, "head-only")
    assert alignment.lenient(beat, f"xx {tail}", 0) == (4, 34, "tail-only")
    shadow = f"{head}middle {tail} and so on until the cursor"
    assert alignment.lenient(beat, shadow, 62) == (0, shadow.index(tail) + len(tail), "backtrack")
    assert alignment.lenient(beat, f"{head}and nothing else up to the cursor", 40) == (0, 30, "backtrack")
    assert alignment.lenient("a short beat", "there was a short beat, and more", 25) == (10, 22, "backtrack")
    run = "twenty six letters in a row"
    assert alignment.lenient("x" * 40 + run + "y" * 40, f"nothing {run} more", 0) == (8, 8 + len(run), "fuzzy")


def test_wrapping_keeps_the_page(spark):
    page = "<html><head><title>T</title></head><body><p>One &amp; <b>two</b>  three</p>\n<p>Four&nbsp;five</p></body></html>"
    nodes = pages.page_shadow(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("node_no").collect()
    whole = [(n.s, n.e, f"b{n.node_no}") for n in nodes]
    out = alignment.wrapped(page, whole)
    import re

    assert re.sub(r'<span class="beat" data-beat-id="b\d+">|</span>', "", out) == page
    assert re.findall(r'data-beat-id="b\d+">([^<]*)</span>', out) == ["One &amp; ", "two", "  three", "Four&nbsp;five"]
    assert alignment.wrapped(page, []) == page
    same = "<p>again</p><p>again</p>"
    assert alignment.wrapped(same, [(6, 11, "z")]) == '<p>again</p><p><span class="beat" data-beat-id="z">again</span></p>'
    pages_ = spark.createDataFrame([(1, page), (2, None), (3, same)], "page_id long, html string")
    found = {r.page_id: r for r in alignment.wrapped_pages(pages_, spark.createDataFrame([(3, "z", 6, 11), (1, "n", None, None)], "page_id long, beat_id string, s long, e long")).collect()}
    assert found[1].html == page and found[2].html is None and found[3].n_beats == 1


def test_references_need_their_semicolon(spark):
    page = "<body><h1>A &amp;&amp</h1><p>b &copy 1 &copy; &#65; &#x42 &notit; &amp;lt; &</p><p>c&am</body>"
    nodes = pages.page_shadow(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("node_no").collect()
    assert [n.raw for n in nodes] == ["A &&amp", "b &copy 1 © A &#x42 &notit; &lt; &", "c&am"]
    assert [(n.s, n.e) for n in nodes] == [(0, 7), (8, 42), (43, 47)]
    out = alignment.wrapped(page, [(n.s, n.e, f"b{n.node_no}") for n in nodes])
    import re

    assert re.findall(r'data-beat-id="b\d+">([^<]*)</span>', out) == ["A &amp;&amp", "b &copy 1 &copy; &#65; &#x42 &notit; &amp;lt; &", "c&am"]


def test_span_matches_in_slices(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    spans = table(spark, SMALL, "benchmark")
    want = {tuple(r) for r in alignment.span_matches(spans, docs).collect()}
    monkeypatch.setattr(alignment, "SLICE_BYTES", 2000)
    assert want and {tuple(r) for r in alignment.span_matches(spans, docs).collect()} == want


def test_page_drops(spark):
    prose = "<p>Coverage of the war, in a long line of prose that nobody would drop.</p>"
    rows = [
        ("toc", prose, "stem"), ("copyright", prose, "stem"), ("cover", prose, None), ("dedication", prose, None), ("about", prose, None), ("index2x", prose, None),
        ("c1", f"<section epub:type='index'>{prose}</section>", "landmark"), ("c2", f"<section epub:type='dedication'>{prose}</section>", None),
        ("c3", f"<div class='pg-boilerplate'>{prose}</div>", "boilerplate"), ("c4", f"<div id='pg-header'>{prose}</div>", "boilerplate"),
        ("c5", "<nav><a href=x>One</a></nav>", "nav"), ("c6", f"<nav><a href=x>One</a></nav>{prose}", None),
        ("c7", f"<h3>Table of  Contents.</h3>{prose}", "heading"), ("c8", f"<h1>Contents of the house</h1>{prose}", None), ("c9", f"<h2>Coverage of the war</h2>{prose}", None),
        ("d1", "<ul>" + "<li><a href=x>A chapter</a></li>" * 5 + "</ul>", "links"), ("d2", "<ul>" + "<li><a href=x>A chapter</a></li>" * 4 + "</ul>", None), ("d3", None, None),
    ]
    df = spark.createDataFrame([(i, s, h) for i, (s, h, _) in enumerate(rows)], "page_id long, stem string, html string")
    assert {r.page_id: r.reason for r in pages.page_drops(df).collect()} == {i: want for i, (_, _, want) in enumerate(rows)}


def test_blocks_and_their_kinds(spark):
    html = (
        "<h1>Title</h1><p>One.</p><pre><code class='brush:rust'>x</code></pre><table><tr><td>a</td></tr></table><figure><img src=a></figure><p></p><table></table>"
        "<aside epub:type='footnote'>n</aside><aside>side</aside><p class='programlisting'>code?</p><p style='font-family: Courier'>mono?</p><p>Two.</p><math>x</math>"
    )
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    blocks = pages.page_blocks(df)
    kinds = [r.kind for r in blocks.orderBy("block_no").collect()]
    assert kinds == ["prose", "code", "table", "figure", "footnote", "prose", "ambiguous", "ambiguous", "prose", "equation"]
    assert [r.language for r in blocks.where("kind = 'code'").collect()] == ["rust"] and pages.page_titles(df).first().title == "Title"
    answers = spark.createDataFrame([(1, 6, "code"), (1, 7, "drop")], "page_id long, block_no long, answer string")
    rest = pages.resolved(blocks, answers).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in rest][5:8] == [("prose", "side"), ("code", ""), ("prose", "Two.")]
    placed = {r.block_no: r.after_paragraph for r in pages.chapter_positions(pages.resolved(blocks, answers).withColumns({"chapter_id": F.lit("01"), "spine_idx": F.lit(0)})).collect()}
    assert placed == {1: 0, 2: 0, 3: 0, 4: 0, 6: 1, 9: 2}
    text = pages.page_text(spark.createDataFrame([(1, "<h2>A <i>b</i></h2><p>One<img src=x> two<p>Three</p><div>no</div><script>p</script><p> </p>")], "page_id long, html string")).first()
    assert (text.title, text.text) == ("A b", "One two\n\nThree")


def test_headers(spark):
    lines = {
        "# 3. The shop": "scene", "## 12 Again": "scene", "# Scene 1: The shop": None, "Scène 4": "scene", "**ACTE II**": "scene", "Act": None, "Prologue": None, "**7**": "scene", "**7\\.**": "scene",
        "3 – Title": "scene", "**3 - Title**": "scene", "3-fold": None, "Séquence iv - dehors": "scene", "# Characters": "roster", "**Personnages :**": "roster", "DISTRIBUTION DES RÔLES": "roster",
        "Les personnages": "roster", "The cast": None, "The characters leave the stage slowly.": None, "Cast list": "roster", "Characters come in, one by one": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    kind = F.when(segments.is_roster_header(F.col("line")), "roster").when(segments.is_scene_header(F.col("line")), "scene")
    assert {r.line: r.k for r in df.select("line", kind.alias("k")).collect()} == lines
    groups = spark.createDataFrame([("TOUS :",), ("**Ensemble**",), ("Anna",)], "x string")
    assert [r[0] for r in groups.select(segments.is_group_label(F.col("x"))).collect()] == [True, True, False]


def test_fuzzy_edges_against_all_pairs(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 14))) for _ in range(120)]
    for x in list(names):
        y = list(x)
        y[rng.randrange(len(y))] = rng.choice("abxyz7")
        names += ["".join(y), "".join(y) + "q", x[1:]]
    names = [" ".join(x.split()) for x in names]
    rows = list(enumerate(names))
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    want = set()
    digits = lambda s: [c for c in __import__("re").findall(r"\d+", s)]
    for (x, a), (y, b) in itertools.combinations(sorted(first.items(), key=lambda p: p[1]), 2):
        if min(len(x), len(y)) >= 4 and abs(len(x) - len(y)) <= 3 and digits(x) == digits(y) and difflib.SequenceMatcher(None, x, y).ratio() >= 0.9:
            want.add((b, a))
    found = {tuple(r) for r in identity.fuzzy_edges(spark.createDataFrame(rows, "entry_id long, norm string")).collect()}
    assert found == want and len(want) > 20


MENTIONS = "entry_id long, chapter_id string, name string, aliases array<string>, gender string, approx_age string, description string, evidence array<string>"


def cast_of(spark, *rows):
    full = [(i, c, n, a, g, "adult", f"{n} in {c}", [f"quote {i}"]) for i, (c, n, a, g) in enumerate(rows)]
    return characters.clusters(spark.createDataFrame(full, MENTIONS))


def test_clusters(spark):
    out = cast_of(
        spark, ("c1", "Ida Moor", ["the porter", "she", "my"], "female"), ("c1", "Olek", ["the porter", "My"], "male"), ("c2", "Sam Reed", ["the porter", "the captain"], "male"),
        ("c2", "Lady Corvane", ["Corvane", "Corv"], "female"), ("c3", "Corvane", [], "unknown"), ("c3", "Corv", [], "female"), ("c3", "Corvanne", ["The Heron"], "female"), ("c4", "Unit 7 Alpha", [], "unknown"), ("c4", "Unit 8 Alpha", [], "unknown"),
    )
    found = {r.name: r for r in out.collect()}
    assert set(found) == {"Ida Moor", "Olek", "Sam Reed", "Lady Corvane", "Unit 7 Alpha", "Unit 8 Alpha"}
    lady = found["Lady Corvane"]
    assert lady.occurrences == 2 and lady.gender == "female" and set(lady.members) == {"Lady Corvane", "Corvane", "Corv", "Corvanne"} and lady.aliases == ["Corvane", "Corv", "Corvanne", "The Heron"]
    assert not found["Ida Moor"].aliases and not found["Sam Reed"].aliases
    assert [r.name for r in characters.ranked(out).limit(2).collect()] == ["Lady Corvane", "Ida Moor"]


def test_merges_by_a_provider(spark):
    out = cast_of(spark, ("c1", "Bob", ["Bobby"], "male"), ("c2", "Robert Kay", [], "male"), ("c3", "Robert Kay", [], "unknown"), ("c1", "Ann", [], "female"))
    merge = lambda sent: '{"groups": [{"canonical": "bobby", "names": ["Bob", "robert  kay"]}, {"names": ["Bob", "Ann"]}, {"names": "Ann"}, {"names": ["nobody", "Ann"]}]}'
    found = {r.name: r for r in characters.merged_by_provider(out, merge).collect()}
    assert set(found) == {"bobby", "Ann"} and found["bobby"].aliases == ["Robert Kay", "Bob"] and found["bobby"].occurrences == 2 and found["bobby"].gender == "male"
    none = characters.merged(out, [{"names": ["Bob", "Robert Kay"], "canonical": "Somebody"}])
    assert {r.name for r in none.collect()} == {"Robert Kay", "Ann"}

    def broken(sent):
        raise TimeoutError

    assert {r.name for r in characters.merged_by_provider(out, broken).collect()} == {"Bob", "Robert Kay", "Ann"}
    assert {(r.kind, r.name): r.disposition for r in characters.dispositions(out, none.where("name = 'Ann'")).collect()} == {("cluster", "Ann"): "kept", ("cluster", "Bob"): "dropped", ("cluster", "Robert Kay"): "dropped", ("character", "Ann"): "matched"}


def test_a_call_is_asked_again(spark):
    seen = []

    def provider(prompt, temperature, budget):
        seen.append((prompt, temperature, budget))
        return [("{bad", "stop"), ('{"a": [1, 2', "length"), ('{"a": [1, 2]}', "stop")][len(seen) - 1]

    answer, why = providers.ask(provider, "p", budget=100)
    assert answer == '{"a": [1, 2]}' and why == "" and [round(t, 1) for _, t, _ in seen] == [0.2, 0.6, 0.6] and [b for _, _, b in seen] == [100, 100, 150]
    assert seen[0][0] == "p" and "not valid" in seen[1][0] and seen[2][0] == "p"
    asked = []
    assert providers.ask(lambda p, t, b: (asked.append(b), ("{", "length"))[1], "p", budget=100, most=120)[0] is None and asked == [100, 120]
    assert providers.ask(lambda p: None, "p")[0] is None
    c = contracts.CONTRACTS["mentions"]
    cut = '{"cast": [{"name": "A", "aliases": "B"}, {"name": "C", "al'
    assert c.items(providers.ask(lambda p: cut, "p", c.items, c.saved)[0])[0]["aliases"] == ["B"]


def test_contracts_and_their_fallbacks(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, html string")
    good = lambda p: '{"kind": "table"}' if "x" in p else "no"
    out, new = contracts.asked(rows, contracts.CONTRACTS["block"], {"html": F.col("html")}, lambda p: good(p[-1:]), "m")
    assert {r.k: r.kind for r in out.collect()} == {1: "table", 2: "prose"} and new.count() == 2
    cues, _ = contracts.asked(rows, contracts.CONTRACTS["cues"], {"lines": F.col("html")}, lambda p: "nothing", "m")
    assert cues.count() == 0
    with pytest.raises(Exception, match="no valid answer"):
        contracts.asked(rows, contracts.CONTRACTS["beats"], {"speakers": F.lit(""), "text": F.col("html")}, lambda p: "nothing", "m")[0].collect()
    again, new = contracts.asked(rows, contracts.CONTRACTS["block"], {"html": F.col("html")}, good, "m", new)
    assert new.count() == 1 and again.count() == 2  # the failed one alone is asked for again
    sounds = contracts.rendered(spark.createDataFrame([("a", "p", "r"), ("b", "", "r")], "cache_key string, prompt string, ref string"), lambda p, r: b"x" if p else 1 / 0)
    assert {r.cache_key: (r.sound is None, r.failed) for r in sounds.collect()} == {"a": (False, False), "b": (True, True)}


def test_phases_run_until_nothing_is_left():
    work = {"refs": 2, "decode": 0}

    def run(phase):
        work[phase] = max(0, work[phase] - 1)
        return True

    assert finishing.driven(["refs", "decode"], work.get, run) == {"refs": 2, "decode": 1}
    with pytest.raises(RuntimeError, match="no progress"):
        finishing.driven(["refs"], lambda p: 3, lambda p: False, 4)


def test_guards_and_folds(spark):
    scenes = spark.createDataFrame([("a", 2), ("b", 0)], "scene_id string, n_beats long")
    assert guards.with_beats(scenes.where("n_beats > 0")).count() == 1
    with pytest.raises(Exception, match="no beats in scene b"):
        guards.with_beats(scenes).collect()
    assert [r.id for r in guards.missing(spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(1,)], "id long"), "id").collect()] == [2]
    rows = [("s", i, "narration", None, f"Sentence number {i} is here.", f"src {i}" if i % 2 else "") for i in range(4000)]
    beats = spark.createDataFrame(rows, "k string, o long, type string, speaker string, text string, source_span string")
    fused = folds.fused(beats, "k", "o").orderBy("fused_no").collect()
    assert sum(r.n_beats for r in fused) == 4000 and max(len(r.text) for r in fused) <= 375 and fused[0].source_span.startswith("src 1 src 3")
    long = spark.createDataFrame([("k", "A b c. " * 100, "X y. " * 40)], "k string, text string, source_span string")
    cut = folds.split_again(long, "k").orderBy("piece_no").collect()
    assert [len(r.text) <= 375 for r in cut] == [True, True] and cut[1].source_span == ""


def test_scripts(spark):
    out = alignment.verbatim_items(spark.createDataFrame([(1, "ANNA: *Good*  morning.\nIt rains.", "dialogue", "ANNA", "good morning."), (2, "x", "dialogue", "BO", "Never said"), (3, "x", "cue", "", "  ")], "k long, chunk string, type string, speaker string, text string"))
    assert {r.k: (r.type, r.speaker, r.was) for r in out.collect()} == {1: ("dialogue", "ANNA", "dialogue"), 2: ("staging", "", "dialogue")}
    chunk = spark.createDataFrame([("\n\n".join(f"line {i} " + "x" * 20 for i in range(10)),)], "t string")
    parts = chunk.select(segments.split_script(F.col("t"), 60)).first()[0]
    assert len(parts) == 5 and "\n\n".join(parts) == chunk.first().t
    people = spark.createDataFrame([(1, "ANNA", "A baker"), (2, "BO", "")], "place long, speaker string, bio string")
    answers = spark.createDataFrame([("BO", "male", "adult", "A friend")], "name string, gender string, approx_age string, description string")
    assert [tuple(r) for r in scripts.filled_characters(people, answers).orderBy("place").collect()] == [(1, "ANNA", "unknown", "unknown", "A baker"), (2, "BO", "male", "adult", "A friend")]
