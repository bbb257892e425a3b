"""Ranking against loops over lists, chunkers on known cases, sources and streams on small files."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import checks as ck
from brindle.functions import citation as ct
from brindle.functions import jsonb as js
from brindle.functions import provisions as pv
from brindle.functions import text as tx
from brindle.functions import wording as wd
from brindle.operators import chunking as ch
from brindle.operators import hydration as hy
from brindle.operators import linking as ln
from brindle.operators import ranking as rk
from brindle.operators import relational as rel
from brindle.operators.retrieval import search
from brindle.sources import html, loading, xml
from brindle.streaming import messages


def loop_adaptive(rows, ratio=0.7, floor=0.05, keep=3):
    bar = max(rows[0][1] * ratio, floor) if rows else 0
    kept = [r for r in rows if r[1] >= bar]
    return rows[: min(keep, len(rows))] if len(kept) < min(keep, len(rows)) else kept


def loop_cutoff(rows, least=3, gap=0.05):
    best, at = -1.0, None
    for i in range(least - 1, len(rows) - 1):
        if rows[i][1] - rows[i + 1][1] > best:
            best, at = rows[i][1] - rows[i + 1][1], i
    return rows if at is None or len(rows) <= least or best <= gap else rows[: at + 1]


def loop_balance(rows, limit, ratio=0.4):
    quota, seen, first, over = int(limit * ratio), {}, [], []
    for r in rows:
        seen[r[2]] = seen.get(r[2], 0) + 1
        (first if seen[r[2]] <= quota else over).append(r)
    return (first + over)[:limit]


def loop_slots(rows, primary, secondary, cap, limit):
    a, b = [r for r in rows if r[2] in primary], [r for r in rows if r[2] in secondary]
    p = max(0, limit - cap)
    out = a[:p] + b[:cap]
    return (out + (a[p:] + b[cap:])[: max(0, limit - len(out))])[:limit]


def loop_diversify(results, candidates, least=2):
    seen, out = {r[0] for r in results}, list(results)
    low = max(results[-1][1] * 0.9, 0.1) if results else 0.1
    for kind in dict.fromkeys(c[2] for c in candidates):
        need = least - sum(r[2] == kind for r in results)
        for c in candidates:
            if need > 0 and c[2] == kind and c[0] not in seen:
                out.append((c[0], low, kind))
                seen.add(c[0])
                need -= 1
    return out


def test_ranking_by_loops(spark):
    rng, lists = random.Random(11), {}
    for i in range(150):
        scores = [round(rng.random(), 2) for _ in range(rng.randrange(0, 14))]
        lists[i] = [(f"{i}-{k}", s, rng.choice("abc")) for k, s in enumerate(scores if i % 3 else sorted(scores, reverse=True))]
    rows = [(i, k + 1, r, s, t) for i, rs in lists.items() for k, (r, s, t) in enumerate(rs)]
    df = spark.createDataFrame(rows, "list_id int, rank int, resource_id string, similarity double, source_type string").repartition(5)

    def got(out):
        by = {i: [] for i in lists}
        for r in sorted(out.collect(), key=lambda r: r["rank"]):
            by[r["list_id"]].append((r["resource_id"], round(r["similarity"], 9), r["source_type"]))
        return by

    cases = [(rk.adaptive_filter(df), loop_adaptive), (rk.natural_cutoff(df), loop_cutoff), (rk.balance(df, 6), lambda r: loop_balance(r, 6)),
        (rk.slots(df, ["a"], ["b"], 2, 5), lambda r: loop_slots(r, "a", "b", 2, 5)), (rk.slots(df, [], [], 2, 5), lambda r: loop_balance(r, 5)),
        (rk.diversify(df.filter("rank <= 3"), df, ["resource_id"]), lambda r: loop_diversify(r[:3], r)), (rk.balance(df, 0), lambda r: [])]
    for out, loop in cases:
        assert got(out) == {i: [(a, round(s, 9), t) for a, s, t in loop(rs)] for i, rs in lists.items()}


def test_balanced_six_of_four_types(spark):
    types = ["hansard"] * 3 + ["bill"] * 2 + ["vote_question"] * 2 + ["politician"]
    df = spark.createDataFrame([(1, i + 1, str(i), 0.9, t) for i, t in enumerate(types)],
        "list_id int, rank int, resource_id string, similarity double, source_type string")
    got = [r["source_type"] for r in rk.balance(df, 6).collect()]
    assert len(got) == 6 and got.count("hansard") <= 2 and got.count("bill") <= 2
    mp = rk.slots(spark.createDataFrame([(1, i + 1, str(i), 0.9, t) for i, t in enumerate(["hansard"] * 3 + ["politician", "riding", "party"])],
        df.schema), *rk.SLOTS["mp_info"], 5)
    assert sorted(r["source_type"] for r in mp.collect()) == ["party", "politician", "riding"]


def test_search_by_loops_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "fr", None]), [rng.gauss(0, 1) for _ in range(4)] if i % 9 else None,
        rng.choice(["Grain law", "the grain", "law law GRAIN", "", None])) for i in range(120)]
    resources = spark.createDataFrame(rows, "resource_id long, source_type string, language string, vector array<float>, text string").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "en", ["grain", "law"]), (2, [0.0, 1.0, 0.0, 0.0], "xx", []), (3, None, "fr", ["law"]),
        (4, [0.0, 0.0, 1.0, 1.0], None, None)], "query_id long, vector array<float>, language string, terms array<string>")
    for kw in ({}, {"fallback": True}, {"per_source": True}):
        one = {tuple(r) for r in search(queries, resources, 5, 0.3, **kw).collect()}
        assert one == {tuple(r) for r in search(queries, resources, 5, 0.3, block=1, **kw).collect()} and one
    from brindle.operators import retrieval

    one = {tuple(r) for r in search(queries, resources, 5, 0.3).collect()}
    with pytest.MonkeyPatch.context() as m:  # in one process: the parts and the rows held do not change the result
        scored = retrieval._scorer
        def small(block, *args):
            run = scored(block, *args)
            def limited(batches):
                retrieval.SCORED_AT_ONCE, retrieval.HELD = 2, 7
                return run(batches)
            return limited
        m.setattr(retrieval, "_scorer", small)
        assert {tuple(r) for r in search(queries, resources, 5, 0.3).collect()} == one
    near = retrieval.search_by_reference(queries.withColumn("reference", F.when(F.col("query_id") < 3, "en")),
        resources.withColumnRenamed("language", "reference"), 4, -1.0).collect()
    for q, v in ((1, [1.0, 0, 0, 0]), (2, [0, 1.0, 0, 0])):
        cos = lambda w: sum(a * b for a, b in zip(v, w)) / sum(b * b for b in w) ** 0.5  # noqa: B023, E731
        want = sorted((r for r in rows if r[2] == "en" and r[3]), key=lambda r: (-round(cos(r[3]), 5), r[0]))[:4]
        assert [r["resource_id"] for r in sorted(near, key=lambda r: r["rank"]) if r["query_id"] == q] == [r[0] for r in want]
    hit = search(queries.filter("query_id = 1"), resources, 200, 2.0).collect()
    assert {r["resource_id"] for r in hit} == {r[0] for r in rows if r[4] in ("Grain law", "law law GRAIN")}
    assert search(queries.limit(0), resources, 5, 0.3).count() == 0 and search(queries, resources.limit(0), 5, 0.3).count() == 0


@pytest.mark.parametrize("text, want", [("", []), ("   ", []), ("Short text.", ["Short text."]),
    ("Line 1.\r\nLine 2.\n\n\n\nLine 3.", ["Line 1.\nLine 2.\n\nLine 3."])])
def test_chunks_of_known_texts(text, want):
    assert ch.by_chars(text) == want


def test_chunks_without_boundaries():
    assert [len(c) for c in ch.by_chars("a" * 1000, 200, 50)] == [200] * 6 + [100, 50]
    assert ch.by_chars("b" * 479, 600, 100) == ["b" * 479] and [len(c) for c in ch.by_chars("b" * 601, 600, 100)] == [600, 101, 100]
    assert ch.by_chars("x" * 90 + ". " + "y" * 60, 100, 20) == ["x" * 90 + ".", "x" * 19 + ". " + "y" * 60, "y" * 20]


@given(st.text(st.sampled_from("ab. ?\n"), max_size=3000), st.integers(300, 700), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_the_text(text, size, overlap):
    chunks, whole, at = ch.by_chars(text, size, overlap), ch.tidy(text), 0
    for c in chunks:
        found = whole.find(c)
        assert found >= 0 and (len(c) <= size + ch.MOVE or c == whole)
        at = max(at, found + len(c))
    assert "".join(whole.split()) == "" or chunks
    budget = ch.by_tokens(text, 40, 8)
    assert all(ch.estimate(c) <= 60 or " " not in c for c in budget)
    assert {w for c in budget for w in c.split()} == set(whole.split())


def test_units_of_provisions():
    assert ch.legal_units("No markers here.") == [ch.Unit("No markers here.", None, None)]
    assert [(u.kind, u.marker) for u in ch.legal_units("Introduction. (1) First. (2) Second.")] == [(None, None), ("subsection", "(1)"),
        ("subsection", "(2)")]
    assert [u.kind for u in ch.legal_units("Main text (a) One (b) Two (c) Three")][1:] == ["paragraph"] * 3
    assert [u.kind for u in ch.legal_units("Content (i) One (ii) Two (iii) Three")][1:] == ["subparagraph"] * 3
    assert [ch.kind_of_marker(m) for m in ("(A)", "(I)", "(c)", "(12)", "(ab)")] == ["clause", "subparagraph", "paragraph", "subsection", None]


def test_bill_chunks_name_their_section():
    bill = "x" * 120 + "\nSUMMARY\nShort.\nPART 1 Fees\n" + "Fees rise. " * 100
    got = ch.bill_chunks(bill, ("Bill C-1",), 400, 50)
    assert got[:2] == ["Bill C-1 | PREAMBLE\n\n" + "x" * 120, "Bill C-1 | SUMMARY\n\nSUMMARY\nShort."]
    assert len(got) > 4 and all(c.startswith("Bill C-1 | PART 1 Fees\n\n") and len(c) <= 400 + ch.MOVE for c in got[2:])
    assert ch.bill_chunks("no heading", ("Bill C-1", "")) == ["Bill C-1\n\nno heading"] and ch.bill_chunks("SUMMARY\na") == [
        "SUMMARY\n\nSUMMARY\na"] and ch.bill_chunks(" ") == []


def test_speeches_by_paragraphs():
    assert ch.paragraph_chunks("<p>One</p><p>Two</p> <b>x</b>", ("Speaker: A",)) == ["Speaker: A\n\nOne\n\nTwo\n x"]
    got = ch.paragraph_chunks("<p>One</p><p>Two</p><p>" + "Three. " * 30 + "</p>", ("S",), 100, 10)
    assert got[0] == "S\n\nOne\n\nTwo" and got[1].startswith("S\n\nThree. Three.") and all(len(c) <= 100 + ch.MOVE for c in got)
    assert ch.paragraph_chunks("z" * 150, ("S",), 100, 10) == ["S\n\n" + "z" * 97, "S\n\n" + "z" * 63, "S\n\n" + "z" * 10]
    assert ch.paragraph_chunks("<p> </p>", ("S",)) == []
    assert ch.with_header("a\r\nb", "H", 20) == ["H\n\na\nb"] and ch.with_header(" ", "H") == []


def test_provisions_with_prefix_and_history():
    notes = [{"text": "S.C. 2001", "enactedDate": "2001-02-03", "inForceStartDate": "2001-02-03"},
        {"text": "am. 2002-01-01", "enactedDate": "2002-01-01", "inForceStartDate": "2003-01-01"}]
    assert ch.history(notes) == "\n\nHistory: S.C. 2001 (enacted: 2001-02-03); am. 2002-01-01 (in force: 2003-01-01)"
    assert ch.history(notes[:1], "fr") == "\n\nHistorique: S.C. 2001 (édicté: 2001-02-03)" and ch.history([]) == ""
    assert ch.legal_chunks("short text", 10, 2, "P\n\n") == ["P\n\nshort text"] and ch.legal_chunks("  ", 10, 2, "P") == []
    text = "Intro words here. " + " ".join(f"({n}) " + "word " * 12 for n in range(1, 6))
    got = ch.legal_chunks(text, 40, 16, "P\n\n")
    assert got[0].startswith("P\n\nIntro") and all(ch.estimate(c) <= 40 for c in got) and got[1].startswith("P\n\n(")
    long_unit = ch.packed(["w " * 60, "tail"], 20, 10, ch.estimate, whole_rest=True)
    assert long_unit[-1].endswith("tail")


def test_text_functions(spark):
    terms = ["définition", "bœuf", "Cæsar", "commissaire à l'accessibilité", "Canada–Colombia", "tax-exempt", None]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert [r[0] for r in df.select(tx.folded_term(F.col("t"))).collect()] == ["definition", "boeuf", "caesar", "commissaire a laccessibilite",
        "canada colombia", "tax exempt", None]
    one = spark.range(1).select(*[tx.translated_regulation_id(F.lit(x), to).alias(f"c{i}") for i,
        (x, to) in enumerate([("SOR-2000-1", "fr"), ("DORS-2000-1", "en"), ("2018_c. 12_s. 187", "fr"), ("C.R.C._ch. 10", "en"),
        ("odd", "fr")])]).first()
    assert list(one) == ["DORS-2000-1", "SOR-2000-1", "2018_ch. 12_art. 187", "C.R.C._c. 10", "odd"]
    dates = spark.createDataFrame([("20240131",), ("2024-01-31T05",), ("2024-13-01",), ("x",), (None,)],
        "d string").select(tx.parsed_date(F.col("d"))).collect()
    assert [r[0] for r in dates] == [dt.date(2024, 1, 31)] * 2 + [None] * 3


def test_candidates_and_near_names(spark):
    df = spark.createDataFrame([("chaise or bureau, table",), ("Version anglaise seulement",), ("seul",)], "t string")
    assert [r[0] for r in df.select(ln.match_candidates(F.col("t"))).collect()] == [["chaise or bureau, table", "chaise", "bureau", "table"],
        ["Version anglaise seulement"], ["seul"]]
    rng = random.Random(8)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 16))) for _ in range(120)]
    names += ["".join(rng.sample(n, len(n))) for n in names[:20]] + [n[:3] + "z" + n[4:] for n in names] + [n[1:] for n in names[:40]] + [None, ""]
    rows = spark.createDataFrame([(i, "g", n) for i, n in enumerate(names)], "i int, g string, n string")
    got = {(r["name_a"], r["name_b"], r["distance"]) for r in ln.near_matches(rows, "i", "g", "n").collect()}
    lev = lambda a, b: edit(a, b)
    short = sorted({n for n in names if n and len(n) >= 5})
    want = {(a, b, d) for a in short for b in short if a < b and abs(len(a) - len(b)) <= 3 and (d := lev(a, b)) <= max(min(3, len(a) // 4), 2)}
    assert got == want and len(want) > 100


def test_names_that_share_a_beginning(spark):
    """All names begin alike; the pieces looked up are those that tell them apart."""
    rng = random.Random(4)
    names = ["an act to establish a fund for " + "".join(rng.choice("abcdefghij") for _ in range(14)) for _ in range(150)]
    names += [n[:-1] for n in names[:30]] + [n[:35] + "x" + n[36:] for n in names[30:60]] + [n + "yz" for n in names[60:80]]
    got = {(r["name_a"], r["name_b"], r["distance"])
        for r in ln.near_matches(spark.createDataFrame([(i, "g", n) for i, n in enumerate(names)], "i int, g string, n string"), "i", "g", "n")
        .collect()}
    assert got == {(a, b, d) for a in set(names) for b in set(names) if a < b and (d := edit(a, b)) <= 3} and len(got) >= 80


def test_near_names_are_merged_not_broadcast(spark):
    """The joined rows are many a name, however small the table of names is estimated; edits stand together, apart and at the ends."""
    rng = random.Random(5)
    names = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in [*range(5, 25), 33, 48, 61, 75]]
    for n in names[:]:
        for places in ([0, 0, 0], [len(n) - 1] * 3, [0, len(n) // 2, len(n) - 1], *([rng.randrange(len(n)) for _ in range(3)] for _ in range(3))):
            x = n
            for at in places[: rng.randrange(1, 4)]:
                x = x[:at] + rng.choice(["", "z", "z" + x[at : at + 1]]) + x[at + 1 :]
            names.append(x)
    rows = spark.createDataFrame([(i, "g", n) for i, n in enumerate(names)], "i int, g string, n string")
    found = ln.near_matches(rows, "i", "g", "n")
    got = sorted((r["name_a"], r["name_b"], r["distance"]) for r in found.collect())
    own = sorted({n for n in names if len(n) >= 5}, key=str.encode)
    near = ((a, b, edit(a, b)) for i, a in enumerate(own) for b in own[i + 1 :] if abs(len(a) - len(b)) <= 3)
    assert got == sorted((a, b, d) for a, b, d in near if d <= max(min(3, len(a) // 4), 2)) and len(got) > 100
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_sequence_breaks_over_stretches(spark):
    rng, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), t0 + dt.timedelta(hours=rng.randrange(400)), rng.choice([None, *range(6)]), i)
        for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, t timestamp_ntz, v int, _v int")
    want = set()
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        want |= {(y[0], x[3]) for x, y in zip(own, own[1:]) if x[3] is not None and y[3] is not None and y[3] <= x[3]}
    for stretch in (None, F.date_trunc("day", "t"), F.date_trunc("hour", "t")):
        assert {(r["id"], r["before"]) for r in ln.sequence_breaks(df, "g", ["t", "id"], "v", stretch).collect()} == want
    assert ln.sequence_breaks(df.limit(0), "g", ["t", "id"], "v").count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_as_of_with_hot_key(spark):
    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    right = [(rng.choice([1, 1, 1, 2, None]), t0 + dt.timedelta(hours=rng.randrange(4000)), rng.randrange(99)) for _ in range(400)]
    left = [(i, rng.choice([1, 2, 3, None]), t0 + dt.timedelta(hours=rng.randrange(-50, 4100)) if i % 20 else None) for i in range(300)]
    out = rel.as_of(spark.createDataFrame(left, "id int, k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, rt timestamp_ntz, v int"),
        "k", "t", "rt", ["v"])
    got = {r["id"]: r["v"] for r in out.collect()}
    want = {i: max(((rt, v) for rk_, rt, v in right if rk_ is not None and rk_ == k and t is not None and rt <= t), default=(None, None))[1] for i, k,
        t in left}
    assert got == want


DOC = """<Statute><Identification><Preamble><Provision>Whereas x.</Provision></Preamble></Identification><Enacts>Now</Enacts><Body>
<Heading level="1">Part 1</Heading><Heading level="2">Fees</Heading><Section><Label>1</Label><MarginalNote>Title</MarginalNote><Text>The <XRefExternal reference-type="act" link="G-1">Grain Act</XRefExternal> applies<Sup>2</Sup>.</Text>
<Definition><Text><DefinedTermEn>fee</DefinedTermEn> means <DefinedTermFr>droit</DefinedTermFr></Text></Definition></Section><Section><Text>unlabelled</Text></Section>
<Heading level="1">Part 2</Heading><Section><Label>2</Label><Text>Table <TableGroup/></Text></Section></Body><Schedule><Item>a<Item>b</Item></Item></Schedule><Order><Provision><Section><Label>9</Label></Section></Provision></Order></Statute>"""


def test_xml_walk(spark, tmp_path):
    rows = xml.document_rows(DOC)
    sections = [(r["ordinal"], r["label"], r["path"]) for r in rows if r["kind"] == "section"]
    assert sections == [(1, "1", ["Part 1", "Fees"]), (2, "2", ["Part 2"]), (3, None, ["Part 2"]), (4, None, ["Part 2"])]
    by = {r["kind"]: r for r in rows}
    assert by["enacting_clause"]["ordinal"] == 0 and by["preamble"]["text"] == "Whereas x." and by["reference"]["label"] == "G-1" and by["reference"][
        "section"] == "1"
    assert (by["definition"]["label"], by["definition"]["title"]) == ("fee", "droit") and rows[[r["label"] for r in rows]
        .index("2")]["flags"] == ["has_table"]
    df = spark.createDataFrame([("a", DOC), ("b", "<x"), ("c", None)], "id string, x string")
    got = xml.document_table(df, "id", "x").groupBy("doc_id").agg(F.count("error").alias("e"), F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in got} == {("a", 0, len(rows)), ("b", 1, 1)}
    for lang, name in (("eng", "A-1"), ("fra", "A-1"), ("eng", "B")):
        (tmp_path / lang / "acts").mkdir(parents=True, exist_ok=True)
        (tmp_path / lang / "acts" / f"{name}.xml").write_text(DOC)
    found = xml.discover(spark, str(tmp_path))
    assert {(r["doc_id"], r["language"]) for r in found.collect()} == {("A-1", "en"), ("A-1", "fr"), ("B", "en")}
    assert xml.document_table(found, "doc_id", "content").filter("kind = 'section'").count() == 12
    (tmp_path / "l.xml").write_text(
        '<D><Statute id="1"><ChapterNumber>C-1</ChapterNumber></Statute><Statute id="2"><ChapterNumber>C-2</ChapterNumber></Statute></D>')
    assert {r["ChapterNumber"] for r in xml.lookup_table(spark, str(tmp_path / "l.xml"), "Statute").collect()} == {"C-1", "C-2"}


def test_html_and_hashes(spark):
    page = spark.createDataFrame([(1, '<a HREF="/x">a</a><script>var a = "<b>";</script>  b&nbsp;c<a href="/y">d</a><a href="/x">e</a>')],
        "id int, h string")
    assert {tuple(r) for r in html.page_links(page, "id", "h").collect()} == {(1, "/x", 0), (1, "/y", 1)}
    assert page.select(html.plain_text(F.col("h"))).first()[0] == "a b c d e"


def test_loads_are_repeatable(spark, tmp_path):
    df, path = spark.createDataFrame([("a:1", "en"), ("a:2", "fr"), ("a:2", "fr"), ("b:1", "en")], "key string, lang string"), str(tmp_path / "t")
    assert [loading.append_new(df, path, "key"), loading.append_new(df, path, "key")] == [3, 0]
    assert loading.without_prefix(spark.read.parquet(path), "key", "a:").count() == 1 == loading.keys_with_prefix(df, "key", "b").count()
    with pytest.raises(ValueError):
        loading.replace_all(df.limit(0), path)
    acts, regs = spark.createDataFrame([("A",)], "act_id string"), spark.createDataFrame([("R1", "A"), ("R2", "Z")],
        "regulation_id string, enabling_act_id string")
    assert {tuple(r) for r in loading.resolve_subset(acts, regs, ["A"], ["R2", "Q"]).collect()} == {("A", True), ("R1", True), ("R2", True),
        ("Q", False)}
    res = spark.createDataFrame([("a", "m1", [1.0]), ("b", "m2", [1.0]), ("c", "m1", [1.0])], "key string, model string, vector array<double>")
    new = loading.reembed(res, spark.createDataFrame([("a", [2.0]), ("b", [2.0])], "key string, vector array<double>"), "key", "m1", "m3").collect()
    assert {tuple(map(str, r)) for r in new} == {("a", "m3", "[2.0]"), ("b", "m2", "[1.0]"), ("c", "m1", "[1.0]")}
    assert loading.unexpected_tables(spark, [t.name for t in spark.catalog.listTables()]) == []


def test_dump_is_read_by_blocks(spark, tmp_path):
    rows = "".join(f"{i}\tname\\t{i}\t\\N\n" for i in range(20_000))
    (tmp_path / "d.sql").write_text("SET x;\nCOPY public.a (id, \"name\", note) FROM stdin;\n" + rows
        + "\\.\n\nCOPY public.b (id) FROM stdin;\n1\n\\.\nCOPY public.c (x) FROM stdin;\nC:\\\\new\\nline\n\\.\nSELECT 1;\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = loading.dump_lines(spark, str(tmp_path / "d.sql"))
        assert lines.rdd.getNumPartitions() > 3
        found = loading.dump_rows(lines, "parliament", ["a", "c"])
        assert {(r["table_name"], r["n"]) for r in found.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()} == {
            ("parliament.a", 20_000), ("parliament.c", 1)}
        assert loading.dump_table(found, "parliament.c", ["x"]).first()[0] == "C:\\new\nline"
        a = loading.dump_table(found, "parliament.a", ["id", "name", "note", "gone"]).filter("id = '7'").first()
        assert tuple(a) == ("7", "name\t7", None, None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checks_of_inputs(spark):
    ids = ["A-1", "c-38.8", "1-A", None, ""]
    rows = spark.createDataFrame([(i,) for i in ids], "x string").select(ck.valid_act_id(F.col("x")), ck.valid_label(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (True, True), (False, True), (False, False), (False, False)]
    numbers = spark.createDataFrame([("12",), ("0",), (" 7x",), ("1000001",), (None,), ("12345678",), ("-3",)],
        "t string").select(ck.positive_integer(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [12, None, 7, None, None, None, None]
    assert [ck.clamped(n) for n in (None, -5, 7, 5000)] == [10, 1, 7, 100]
    got = spark.range(1).select(ck.amendment(F.lit("2023, C. 8, s. 46")).alias("a"), ck.amendment(F.lit("2019, c. 10")).alias("b"),
        ck.amendment(F.lit("x")).alias("c"), ck.regulation_id(F.lit("C.R.C., c. 10/2")).alias("d"), ck.file_name(F.lit("SOR/97 1"))
        .alias("e")).first()
    assert (tuple(got["a"]), tuple(got["b"]), got["c"], got["d"], got["e"]) == ((2023, 8, 46), (2019, 10, None), None, "C.R.C._c. 10-2", "SOR-97_1")


def test_json_tests_and_changes(spark):
    texts = ['{"a": 1, "r": [{"c": "x"}, 2], "é\\"": null, "o": {"z": [1.5]}}', '{"r": "[]"}', "[1]", None, '{"r": []}', "{"]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(js.array_length(t, "r"), js.has_element(t, "r", "x", "c"),
        js.contains(t, {"a": 1}), js.with_member(t, "a", F.lit('q"é'))).collect()
    assert [r[0] for r in rows] == [2, None, None, None, 0, None] and [r[1] for r in rows] == [True] + [False] * 5 and [r[2]
        for r in rows] == [True] + [False] * 5
    assert [json.loads(r[3]) if r[3] else None for r in rows] == [{"o": {"z": [1.5]}, "r": [{"c": "x"}, 2], 'é"': None, "a": 'q"é'},
        {"r": "[]", "a": 'q"é'}, None, None, {"r": [], "a": 'q"é'}, None]


def test_wordings(spark):
    fields = {"a": F.lit("x"), "b": F.lit(""), "n": F.lit(3)}
    cases = {"{a|d} {b|d{n}}": "x d3", "<a:[{a}<b:!>]><!b: none>": "[x] none", "plain": "plain", "{z}": "", "": ""}
    row = spark.range(1).select(*[wd.worded(w, fields).alias(f"c{i}") for i, w in enumerate(cases)],
        wd.lined(["?A: {a}", "?B: {b}", "C: {b}", "?D: {a} {z}"], fields).alias("l")).first()
    assert list(row)[:-1] == list(cases.values()) and row["l"] == "A: x\nC: "


def test_known_citations(spark):
    law = {"actId": "C-46", "documentTitle": "Criminal Code", "sectionLabel": "3.1(a)", "targetType": "act", "targetRef": "A-1"}
    fields = ct.legislation_fields({k: F.lit(v) for k, v in law.items()})
    got = spark.range(1).select(*[ct.citation(F.lit(kind), fields, ct.LEGISLATION).alias(kind)
        for kind in ("act_section", "cross_reference", "marginal_note")]).first()
    assert got["act_section"]["text_fr"] == "[Criminal Code, art 3.1(a)]" and got["act_section"][
        "url_en"] == "https://laws-lois.justice.gc.ca/eng/acts/C-46/page-1.html#sec3.1a"
    assert got["cross_reference"]["text_en"] == "[Criminal Code → Act A-1]" and got["cross_reference"]["url_fr"].endswith("/fra/lois/A-1/page-1.html")
    assert got["marginal_note"]["title_fr"] == "Article 3.1(a) de Criminal Code: Note marginale"
    house = ct.parliament_fields({"billNumber": F.lit("C-35"), "sessionId": F.lit("44-1"), "result": F.lit("N"), "politicianName": F.lit("")})
    bill = spark.range(1).select(ct.citation(F.lit("bill"), house, ct.PARLIAMENT).alias("b"), ct.citation(F.lit("vote_member"), house, ct.PARLIAMENT)
        .alias("v"), ct.citation(F.lit("none"), house, ct.PARLIAMENT).alias("n")).first()
    assert bill["b"]["text_en"] == "[Bill C-35, 44th Parliament, 1st Session]" and bill["b"][
        "url_fr"] == "https://www.parl.ca/legisinfo/fr/projet-de-loi/44-1/c-35"
    assert bill["v"]["text_fr"] == "[Député inconnu, date inconnue, Non]" and bill["n"]["text_en"] is None


def test_documents_are_cut_to_their_caps(spark):
    docs = spark.createDataFrame([("A", "en", "Act", "Long", "in-force", None, None), ("B", "fr", "Loi", None, None, None, None)],
        "doc string, language string, title string, long_title string, status string, consolidated string, enabling string")
    sections = spark.createDataFrame([("A", "en", i, str(i), None, "section", "x" * 50) for i in range(40)],
        "doc string, language string, ord int, label string, note string, kind string, content string")
    got = {r["doc"]: r for r in hy.document_markdown(docs, sections, 30, 1200).collect()}
    a = got["A"]["markdown"]
    assert got["A"]["total"] == 40 and a.startswith("# Act\n\n*Long*\n\n> *Showing 30 of 40 sections.") and a.endswith(
        "See Justice Canada website for full text.*") and len(a) < 1300
    assert "## Table of Contents\n\n- 0\n" in a and got["A"]["shown"] == a.count("### Section ") > 3
    assert (got["B"]["markdown"], got["B"]["shown"], got["B"]["total"]) == ("# Loi\n", 0, 0)


def test_bill_bodies(spark):
    text = "Intro Short Title of it\nPART 2 Fees apply\n1 (1) x (a) one (b) two\nFirst (i) a (ii) b\nfee means a sum"
    got = spark.range(1).select(hy.bill_body(F.lit(text)).alias("b")).first()[0]
    assert "### Short Title of it" in got and "## Part 2 — Fees apply" in got and "- (a) one\n- (b) two" in got and "- **fee** — a sum" in got


def test_streams(spark, small, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    for n in (1, 2):
        messages.load_stream(stream, out, "event_id", str(tmp_path / f"check{n}")).awaitTermination(120)
        assert spark.read.parquet(out).count() == events.count()
    counts = messages.windowed_counts(stream, "user_id", "ts")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation",
        str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("rows")).first()[0] == 24 * events.count()
    assert messages.over_limit(spark.table("counts"), 0).count() == spark.table("counts").count()


def test_section_numbers_and_scopes(spark):
    cases = {"sections 17 to 19 and 21 to 23": ["17", "18", "19", "21", "22", "23"], "sectionsto.73 75": ["73", "74", "75"],
        "90.02 to 90.24": ["90.02", "90.24"], "section 4": ["4"], "1 to 9000000": ["1"], None: [], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", pv.section_numbers("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases
    scopes = {"In this Act,": "act", "Dans la présente partie": "part", "in this Regulation": "regulation",
        "apply in this section and sections 3 to 5": "section", "apply in sections 2 to 4": "section", "hello": None, None: None}
    rows = spark.createDataFrame([(t,) for t in scopes], "t string").select("t", pv.scope_kind(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == scopes


def test_scopes_name_their_sections(spark):
    assert pv.scope_of("The definitions apply in this section and in sections 3 to 5.", "2") == ("section", ["2", "3", "4", "5"])
    assert pv.scope_of("s'appliquent au présent article et aux articles 7 et 9", "6") == ("section", ["6", "7"])
    assert pv.scope_of("The following definitions apply in sections 90.02 to 90.24.", None) == ("section", ["90.02", "90.24"])
    assert pv.scope_of("In this Act,", "1") == ("act", None) and pv.scope_of("x", "1", "regulation") == ("regulation", None) and pv.scope_of(None,
        None) == ("act", None)
    assert len(pv.section_list("sections 1 to 20000")) == 20_000
    rows = spark.createDataFrame([("In this Part", "1"), ("apply in this section", "4"), (None, None)],
        "w string, c string").select(pv.scope("w", "c").alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [("part", None), ("section", ["4"]), ("act", None)]


def test_corrections_and_json(spark):
    df = spark.createDataFrame([("A", "Recieve RECIEVE recieve"), ("B", "recieve"), ("A", None), (None, "x")], "d string, t string")
    assert [r[0] for r in df.select(pv.corrected(F.col("d"), F.col("t"), {"A": [("recieve", "receive")]})).collect()] == ["Receive RECEIVE receive",
        "recieve", None, "x"]
    js = spark.createDataFrame([('{"b": 1, "a": null}', '{"b": 1}', True), ('[1, 2]', '[2, 1]', False),
        ('{"a": [{"x": 1, "y": 2}]}', '{"a": [{"y": 2, "x": 1}]}', True), (None, "null", False), ("{", "{", True)],
        "a string, b string, same boolean")
    assert all(r[0] for r in js.select(pv.comparable_json("a").eqNullSafe(pv.comparable_json("b")) == F.col("same")).collect())


def test_places_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(30)])) for i in range(700)]
    got = rel.placed(spark.createDataFrame(rows, "id int, k string, v int").repartition(7), ["k"], ["v", "id"], "place").collect()
    want = {}
    for k in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0]: i + 1 for i, r in enumerate(own)}
    assert {r["id"]: r["place"] for r in got} == want
    assert rel.placed(spark.createDataFrame([], "id int, k string, v int"), ["k"], ["v"], "place").count() == 0


def test_trailing_counts_of_a_hot_key(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), t0 + dt.timedelta(minutes=30 * rng.randrange(300)) if i % 25 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz, _n int")
    got = {r["id"]: (r["trailing"], r["_n"]) for r in rel.trailing_count(df, "k", "t", 24).collect()}
    near = lambda a, b: a is None and b is None or None not in (a, b) and dt.timedelta(0) <= a - b <= dt.timedelta(hours=24)
    assert got == {i: (sum(k2 == k and near(t, t2) for _, k2, t2, _ in rows), i) for i, k, t, _ in rows}
    assert rel.trailing_count(df.limit(0), "k", "t", 24).count() == 0
