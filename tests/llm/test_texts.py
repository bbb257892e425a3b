"""Conversations, pieces and token ids against brute force."""

import datetime as dt
import json
import random
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences

from brindle.llm import conversations as chats
from brindle.llm import queries as q
from brindle.llm.splitting import split_items, split_text
from brindle.llm.tokens import FragmentEncoder, count_tokens, default_tokenizer, encode_texts


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(default_tokenizer(), "rb") as f:
        return FragmentEncoder(f.read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_agrees_with_sql(spark, medium, name):
    assert differences(spark, medium, q.QUERIES[name], q.ORACLE[name]) == ""


def encoded(encoder, texts):
    sizes, ids = encoder.encode(pa.array(texts, pa.string()))
    ids = iter(ids)
    return [[next(ids) for _ in range(n)] for n in sizes]


@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \t\n\r  　\u0085'stlrevmd.!aéП1"))), max_size=40),
    max_size=6))
@settings(max_examples=1500, deadline=None)
def test_fragments_give_the_ids_of_whole_texts(encoder, texts):
    assert encoded(encoder, texts) == [encoder.encoding.encode_ordinary(t) for t in texts]


def test_ids_of_all_documents(spark, medium, encoder):
    texts = pd.read_parquet(f"{medium}/documents.parquet").set_index("doc_id")["text"]
    for r in q.p7_ids(spark, medium).collect():
        assert r["ids"] == encoder.encoding.encode_ordinary(texts[r["doc_id"]] or "")


def test_ids_of_odd_texts(spark, encoder):
    rows = [(1, None, 7), (2, "", 7), (3, "<|endoftext|>", 7), (4, "ab  é x" * 200_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df, "text").collect()}
    assert got == {i: encoder.encoding.encode_ordinary(t or "") for i, t, _ in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "text").collect()} == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.limit(0), "text").count() == 0


def refused(messages):
    """The rule, read from the statement, over plain rows (id, chat, role, parts, time)."""
    by = defaultdict(dict)
    for i, chat, role, parts, at in messages:
        if chat is not None:
            by[chat][i] = (role, parts, at)
    out = set()
    for chat, rows in by.items():
        turns, bad = [], False
        for role, parts, at in rows.values():
            role = role.strip().lower() if role else role
            try:
                parts = json.loads(parts)
            except (TypeError, ValueError):
                parts = None
            if at is None or role not in ("user", "assistant", "system") or not isinstance(parts, list):
                bad = True
                break
            text = any(isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str) and p["text"].strip() for p in parts)
            if role != "system":
                turns.append((at, role != "user", text))
        turns.sort(key=lambda t: t[:2])
        if bad or not turns or turns[0][1] or any(not late and not text for _, late, text in turns):
            out.add(chat)
            continue
        users = [i for i, t in enumerate(turns) if not t[1]] + [len(turns)]
        if any(not any(t[2] for t in turns[a + 1 : z]) for a, z in zip(users, users[1:])):
            out.add(chat)
    return out


def plain(df):
    return [(r.id, r.chat_id, r.role, r.parts, None if pd.isna(r.created_at) else r.created_at) for r in df.itertuples()]


def test_chats_by_brute_force(spark, medium):
    rows = pd.read_parquet(f"{medium}/message_v2.parquet")
    want = refused(plain(rows))
    assert sorted(r["chat_id"] for r in q.p2_found(spark, medium).collect()) == sorted(want)
    got = q.p2_conversations(spark, medium).toPandas().sort_values(["chat_id", "turn"])
    kept = rows[rows.chat_id.notna() & ~rows.chat_id.isin(want)].drop_duplicates("id")
    assert len(got) == len(kept) and set(got.chat_id) == set(kept.chat_id)
    for _, g in got.groupby("chat_id"):
        assert list(g.turn) == list(range(len(g))) and g.created_at.is_monotonic_increasing


def test_long_chats_span_partitions(spark):
    rng, t0, rows = random.Random(5), dt.datetime(2024, 1, 1), []
    say = json.dumps([{"type": "text", "text": "x"}])
    for chat in range(12):
        at, state = 0, "user"
        for i in range(rng.choice([1, 2, 40, 900])):
            role = state if rng.random() < 0.995 else rng.choice(["user", "assistant", "system"])
            rows.append((f"{chat}-{i}", str(chat), role, say if rng.random() < 0.999 else "[]", t0 + dt.timedelta(seconds=at)))
            state, at = ("assistant" if role == "user" else "user"), at + rng.choice([0, 1, 1, 1])
    rows.append((None, "n", "user", say, t0))
    rows.append((None, "n", "assistant", say, t0))
    rows.append((None, None, "user", say, t0))
    df = spark.createDataFrame(rows + rows[:500], "id string, chat_id string, role string, parts string, created_at timestamp_ntz").repartition(7)
    got = {r["chat_id"] for r in chats.refused_chats(df).collect()}
    assert got == refused([(i if i is not None else f"null{k}", *r) for k, (i, *r) in enumerate(rows)])
    assert chats.refused_chats(df.limit(0)).count() == 0 and chats.conversations(df.limit(0)).count() == 0
    turns = chats.conversations(df).groupBy("chat_id").count().collect()
    assert {r["chat_id"]: r["count"] for r in turns} == {c: sum(r[1] == c for r in rows) for c in {r[1] for r in rows} - got - {None}}


@given(st.text(st.sampled_from("ab .\n,é。"), min_size=0, max_size=900), st.integers(8, 60), st.integers(0, 7))
@settings(max_examples=500, deadline=None)
def test_pieces_cover_and_keep_the_limits(text, limit, overlap):
    spans = split_text(text, limit, overlap, reach=limit // 4)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < z - a <= limit for a, z in spans)
    assert all(a0 < a1 and z0 < z1 and 0 <= z0 - a1 <= overlap for (a0, z0), (a1, z1) in zip(spans, spans[1:]))
    assert len(text) > limit or len(spans) == 1


@pytest.mark.parametrize("before", [4400, 4500, 4700])
def test_long_runs_are_cut_only_where_no_boundary_is_left(before):
    words = "word " * 4000
    text = words[:before] + "x" * 1500 + " " + words[:4000]
    spans = split_text(text)
    assert all(text[z - 1] == " " for _, z in spans[:-1]) and len(spans) > 1
    assert all(0 < z - a <= 6144 for a, z in spans) and all(z0 >= a1 for (_, z0), (a1, _) in zip(spans, spans[1:]))
    assert [z for _, z in split_text("x" * 9000)] == [5012, 9000]


def clean(t):
    import re

    return re.sub(r"\n{3,}", "\n\n", (t or "").replace("\r\n", "\n").replace("\r", "\n")).strip()


def test_oversized_items(spark, medium):
    chunk, said = pd.read_parquet(f"{medium}/chunk_input.parquet"), pd.read_parquet(f"{medium}/hansards_statement.parquet")
    want = {("chunk_input", r.item_id) for r in chunk.itertuples() if len(clean(r.content)) > 6144} | {("hansards_statement", r.id)
        for r in said.itertuples() if len(clean(r.content_fr)) > 6144}
    got = [tuple(r) for r in q.p4_found(spark, medium).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    texts = {("chunk_input", r.item_id): clean(r.content) for r in chunk.itertuples()}
    at_boundary = total = 0
    for r in q.p4_pieces(spark, medium).filter("table_name = 'chunk_input'").collect():
        whole = texts["chunk_input", r["item_id"]]
        assert r["text"] == whole[r["start"] : r["end"]] and len(r["text"]) <= 6144
        if r["end"] < len(whole) and " " in whole[r["end"] - 400 : r["end"]]:
            total, at_boundary = total + 1, at_boundary + whole[r["end"] - 1].isspace()
    assert total and at_boundary == total


def test_pieces_of_odd_items(spark):
    rows = [(1, None, 0), (2, " \n\t ", 0), (3, "a" * 20000, 0), (None, "x", 0), (4, " " * 300_000 + "b", 0)]
    df = spark.createDataFrame(rows, "id int, text string, item_id int")
    got = split_items(df, "id", "text").collect()
    assert {(r["item_id"], r["n_pieces"]) for r in got} == {("3", 4), (None, 1), ("4", 1)}
    assert split_items(df.limit(0), "id", "text").count() == 0
