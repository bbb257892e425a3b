"""Alignment, mixing and abusive content on built cases and held-out rows."""

import random

import numpy as np
import pandas as pd
import pytest

from brindle.llm import abuse, alignment, mixing
from brindle.llm import queries as q

SPLIT = alignment.sentences


def test_alignment_of_cut_merged_and_swapped_sentences(medium):
    """Statements whose numbers agree sentence by sentence, changed at random; the true pairs are known."""
    rng, right, wrong, lost = random.Random(2), 0, 0, 0
    for r in pd.read_parquet(f"{medium}/hansards_statement.parquet").itertuples():
        a, b = SPLIT(r.content_en), SPLIT(r.content_fr)
        if len(a) != len(b) or len(a) < 4 or any(alignment._anchors(x)[0] != alignment._anchors(y)[0] for x, y in zip(a, b)):
            continue
        parts, k = [[j] for j in range(len(b))], rng.randrange(len(b) - 1)
        kind = rng.choice(["cut", "merge", "swap", "none"])
        if kind == "cut":
            del b[k], parts[k]
        elif kind == "merge":
            b[k : k + 2], parts[k : k + 2] = [b[k].rstrip(".!? ") + " – " + b[k + 1]], [parts[k] + parts[k + 1]]
        elif kind == "swap":
            b[k], b[k + 1], parts[k], parts[k + 1] = b[k + 1], b[k], parts[k + 1], parts[k]
        true = {(i, j) for j, own in enumerate(parts) for i in own}
        got = set(alignment.align(a, b, 1.17))
        right, wrong, lost = right + len(got & true), wrong + len(got - true), lost + len(true - got)
    assert right > 80 and 2 * right / (2 * right + wrong + lost) > 0.93


def test_alignment_does_not_depend_on_the_window(medium, monkeypatch):
    """Over 600 sentences a side, with sentences moved over an edge and far away and a long run left out."""
    rng = random.Random(7)
    a = [f"Item {1000 + i} was {rng.choice(['passed', 'read', 'tabled'])} in {rng.randrange(1, 99)} places." for i in range(1700)]
    order = [*range(100), *range(900, 1700)]  # 800 are left out
    for i, place in ((950, 60), (1299, 250), (1650, 5), (20, 880)):
        order.remove(i)
        order.insert(place, i)
    b = [f"Le point {a[i].split()[1]} a été traité à {a[i].split()[-2]} endroits." for i in order]
    got = alignment.align(a, b, 1.0)
    true = {(i, j) for j, i in enumerate(order)}
    assert len(true & set(got)) >= 898 and len(set(got) - true) <= 2
    rows = [(SPLIT(r.content_en), SPLIT(r.content_fr)) for r in pd.read_parquet(f"{medium}/hansards_statement.parquet").head(60).itertuples()]
    whole = [alignment.align(x, y, 1.17) for x, y in rows]
    for window in (1, 2, 3, 5, 8):
        monkeypatch.setattr(alignment, "WINDOW", window)
        assert [alignment.align(x, y, 1.17) for x, y in rows] == whole
    monkeypatch.setattr(alignment, "WINDOW", 2000)
    assert alignment.align(a, b, 1.0) == got


def test_alignment_of_odd_rows(spark):
    said = "The vote was 212 to 9. Costs rose by 4.5% in Ostrand. We will oppose it!"
    rendered = "Il y a eu 212 voix contre 9. À Ostrand, les coûts ont augmenté de 4,5 %. Nous nous y opposerons !"
    rows = [(1, said, rendered, 0), (2, None, rendered, 0), (3, said, "", 0), (4, " ", None, 0), (5, (said + " ") * 500, (rendered + " ") * 500, 0),
        (None, said, rendered, 0)]
    df = spark.createDataFrame(rows, "k int, a string, b string, en_pos int")
    got = alignment.align_documents(df, ["k"], "a", "b").collect()
    assert {(r["k"], r["en_pos"], r["fr_pos"]) for r in got if r["k"] != 5} == {(k, i, i) for k in (1, None) for i in range(3)}
    assert sum(r["en_pos"] == r["fr_pos"] for r in got if r["k"] == 5) > 1400
    lists = spark.createDataFrame([(1, ["Seed Act", None], ["", "Loi sur les semences"]), (2, None, ["x"]), (3, [], [])],
        "k int, a array<string>, b array<string>")
    assert [tuple(r) for r in alignment.align_documents(lists, ["k"], "a", "b").collect()] == [(1, 0, 1)]
    assert alignment.align_documents(df.limit(0), ["k"], "a", "b").count() == 0


def test_found_pairs_are_places_of_sentences(spark, small):
    rows = q.p6_found(spark, small).collect()
    texts = {str(r.id): r for r in pd.read_parquet(f"{small}/hansards_statement.parquet").itertuples()}
    assert len(rows) == len(set(rows)) > 50
    for r in rows:
        if r["table_name"] == "hansards_statement":
            assert r["en_pos"] < len(SPLIT(texts[r["record_key"]].content_en)) and r["fr_pos"] < len(SPLIT(texts[r["record_key"]].content_fr))
        else:
            assert {r["en_pos"], r["fr_pos"]} <= {0, 1}


def make_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies int")


def test_mixture_meets_shares_within_caps(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([" Big", "big", "big"]), rng.randrange(1, 900), 0) for i in range(6000)]
    rows += [(10_000 + i, "small", rng.randrange(1, 300), 0) for i in range(400)] + [(20_000, None, 50, 0), (20_001, "other", 50, 0),
        (20_002, "big", 0, 0), (20_003, "big", None, 0)]
    targets = spark.createDataFrame([("BIG", 0.6, 1), ("small ", 0.3, 4), ("gone", 0.1, 9), (None, 0.2, 1)],
        "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(make_docs(spark, rows), targets).cache()
    got = {r["doc_id"]: r for r in mixed.collect()}
    assert set(got) == {r[0] for r in rows} and all(got[i]["copies"] == 0 for i in range(20_000, 20_004))
    tokens = {s: sum(r["copies"] * r["n_tokens"] for r in got.values() if r["source"] == s) for s in ("big", "small")}
    assert all(0 <= r["copies"] <= {"big": 1, "small": 4}.get(r["source"], 0) for r in got.values())
    assert abs(tokens["big"] / sum(tokens.values()) - 2 / 3) < 2e-3
    rates = [r["rate"] for r in got.values() if r["source"] == "big" and r["n_tokens"]]
    assert abs(sum(r["rate"] * r["n_tokens"] for r in got.values() if r["source"] == "big") - 2 * tokens["small"]) < 1 and max(rates) <= 1
    report = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    assert report["gone"]["actual_share"] == 0 and report["other"]["target_share"] is None and report[None]["documents"] == 1
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(make_docs(spark, rows[::-1]).repartition(5), targets).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    empty = mixing.mix_sources(make_docs(spark, []), targets)
    assert empty.count() == 0 and mixing.share_report(empty, targets).count() == 4


def test_few_large_documents_meet_their_share(spark):
    """One document is worth many small ones: the tokens still come as near to the goal as half of the least spare one."""
    rng = random.Random(4)
    for trial in range(3):
        sizes = [rng.choice([16_340, 22_044, 9_000, *range(100, 2_500, 97)]) for _ in range(30)]
        rows = [(i, "few", n, 0) for i, n in enumerate(sizes)] + [(1000 + i, "many", rng.randrange(1, 400), 0) for i in range(3000)]
        targets = spark.createDataFrame([("few", rng.choice([0.2, 0.31]), 3), ("many", 0.4, 1)],
            "source string, target_share double, max_repeats int")
        got = mixing.mix_sources(make_docs(spark, rows), targets).collect()
        tokens = {s: sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == s) for s in ("few", "many")}
        aims = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.collect()]
        want = {g.source: g.tokens for g in mixing.goals(aims, {s: sum(n for _, t, n, _ in rows if t == s) for s in ("few", "many")}, None)}
        assert all(0 <= r["copies"] <= {"few": 3, "many": 1}[r["source"]] for r in got)
        assert all(abs(tokens[s] - want[s]) <= 60 for s in want), (tokens, want)


def test_goals_beyond_reach_exhaust_small_sources():
    aims = [("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 3)]
    got = {g.source: (g.tokens, g.full) for g in mixing.goals(aims, {"a": 1000, "b": 100, "c": 5}, total=800)}
    assert got == {"a": (600.0, False), "b": (200.0, True)}
    assert {g.source: g.tokens for g in mixing.goals(aims, {"a": 1000, "b": 100}, None)} == {"a": 200.0, "b": 200.0}
    assert mixing.goals(aims, {}, None) == []


def test_gapped_kernel_by_brute_force():
    def kernel(s, t):
        def maps(x):
            x, out = f" {x} ", {}
            for p, span in abuse.SPANS:
                for i in range(len(x)):
                    for o in [o for o in abuse._OFFSETS if len(o) == p]:
                        if i + o[-1] < len(x):
                            key = "".join(x[i + k] for k in o)
                            out[key] = out.get(key, 0) + abuse.DECAY ** (o[-1] + 1 - p)
            return out

        a, b = maps(s), maps(t)
        return sum(v * b.get(k, 0) for k, v in a.items()) / (abuse._MASS * np.sqrt((len(s) + 2) * (len(t) + 2)))

    words = ["idiot", "i.d.i.o.t", "harbour", "you idiot", ""]
    x = abuse.embedded(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert x[i] @ x[j] == pytest.approx(kernel(s, t), abs=0.03)
    assert x[0] @ x[1] > 3 * (x[0] @ x[2])


def test_folding():
    assert list(abuse.passages("Tu vas sаіgnеr, i​m​b​é​c​i​l​e!\nf.i.l.t.h.y moroooon 1 234")) == ["tu vas saigner imbecile", "filthy moron 0 0"]
    assert list(abuse.passages(" ?! \n")) == []


def test_remembered_tokens_agree_with_the_patterns(medium):
    """The words are those of the patterns over whole lines."""
    rng, odd = random.Random(3), ["i", "d.", "i", "o", "t!", "n'y", "a", "y", "a-t-il", "foo-b", "i.d", ".i", "b-foo", "\u00a8x", "x\u00a0y", "…",
        "Ｆｕｌｌ", "ﬁn",
        "w\u200bo", "s. t. u", "\u0301", "!!!", "ЅОЅ", "12", "e2e", "ça…", "\u2028", "\x85", "i_d", "1", "a1", "_", "x_"]
    texts = [t for t in pd.read_parquet(f"{medium}/documents.parquet").text if t]
    texts += [rng.choice([" ", " ", "\n", "  "]).join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(6000)]
    for text in texts:
        assert list(abuse.words_of(text)) == [w for line in text.split("\n") for w in abuse.plain_words(line)], text


def test_held_out_accuracy(spark, medium):
    base = medium.replace("sf0.01", "sf0.1")
    documents = spark.read.parquet(f"{base}/documents.parquet")
    docs = abuse.labelled(spark.read.parquet(f"{base}/abuse_labels.parquet"), documents)
    rng = random.Random(4)
    rng.shuffle(docs)
    half = len(docs) * 2 // 3
    common, n = abuse.word_frequencies(documents, docs[:half])
    assert n == documents.filter("text is not null").count() and set(common) <= {w for t, _ in docs[:half] for p in abuse.passages(t)
        for w in p.split()}
    assert len(abuse.labelled(spark.read.parquet(f"{base}/abuse_labels.parquet"), documents, 50)) in range(45,
        51) and not abuse.labelled(spark.read.parquet(f"{base}/abuse_labels.parquet"), documents, 50, 3)
    model = abuse.fit(docs[:half], common, n)
    right = wrong = lost = 0
    for text, bad in docs[half:]:
        found = max(abuse.scores(list(abuse.passages(text)), model), default=-9) > model.threshold
        right, wrong, lost = right + (found and bad), wrong + (found and not bad), lost + (not found and bad)
    assert right / (right + wrong) > 0.8 and right / (right + lost) > 0.6


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a", None, 0.5), (2, None, "", 0.5), (3, "a", "!!! ...", 0.5), (4, "a", "you filthy vermin " * 50_000, 0.5),
        (5, "a", "the harbour is quiet", 0.5)], "doc_id long, source string, text string, score double")
    model = abuse.fit([("you filthy vermin.", True), ("filthy vermin all of you", True), ("the harbour is quiet.", False),
        ("costs rose in the spring", False)])
    got = {r["doc_id"]: r for r in abuse.score_documents(docs, model).collect()}
    assert [got[i]["score"] for i in (1, 2, 3)] == [None] * 3 and got[4]["abusive"] and not got[5]["abusive"]
    assert abuse.word_frequencies(docs.limit(0), [("a b", True)]) == ({}, 0) and abuse.word_frequencies(docs,
        [("Filthy harbour?", True)]) == ({"filthy": 1, "harbour": 1}, 4)
    assert abuse.fit([]) is None and abuse.fit([("a b", False)]) is None
    assert abuse.score_documents(docs, None).filter("abusive").count() == 0 and abuse.score_documents(docs.limit(0), model).count() == 0
