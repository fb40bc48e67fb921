"""Chat formatting: exact round trip, loss mask, and the machine over roles."""

import hashlib
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from halflight.llm import chat

SF = "/root/testdata/sf0.01"
T = chat.Template()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_table(spark):
    from halflight.llm.queries import QUERIES

    turns = defaultdict(list)
    said = "</s>[INST] ok [/INST]"
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in QUERIES["op4_chat_formatting"](spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        learned = "".join(text for _, role, text in rows if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows) and r.loss_chars == len(learned) and r.loss_sha256 == sha(learned)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in rows))
        assert r.formatted_chars >= sum(len(text) for _, _, text in rows)


pieces = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role ", "<|role", "|>",
                          "<|end|>", "<|end", "<|", "|", "\\", "<", "\n", " ", "x", "é😀"])
roles = st.lists(pieces, max_size=4).map("".join)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(
    ["user", "assistant", "system", "tool", "", "<|end|>", "a\\|>", "x<|end"]), roles),
                          st.lists(pieces, max_size=8).map("".join)), max_size=5))
def test_round_trip(turns):
    formatted = "".join(s for role, text in turns for _, s, _ in chat.segments_of(role, text, T))
    assert chat.Reader(T).turns(formatted) == turns
    for role, text in turns:
        escaped = T.escape_text(text)
        assert T.unescape_text(escaped) == text
        assert not any(c in escaped for c in T.controls())


def test_machine_and_odd_rows(spark):
    rows = [(1, 0, "assistant", "early"), (1, 1, "user", None), (2, 0, "system", "s"), (2, 1, "user", "u"),
            (2, 2, "assistant", "a"), (3, 0, None, "no role"), (3, 0, None, "no role"), (None, 5, "user", "u"),
            (None, None, "assistant", ""), (4, 0, "user", "x" * 200000), (4, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as loss")
    segments = chat.format_chat(df)
    loss = {(r.conv_id, r.segment) for r in segments.collect() if r.loss}
    assert loss == {(1, "early"), (2, "a"), (None, ""), (4, "y")}
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got[1].first_error == "assistant after the start" and got[1].n_turns == 2
    assert got[2].n_errors == 0 and got[4].n_errors == 0 and got[4].loss_chars == 1
    assert got[3].n_turns == 2 and got[3].turns_sha256 == sha("\nno role\n" * 2)
    assert got[None].turns_sha256 == sha("assistant\n\nuser\nu\n") and got[None].n_errors == 2
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r for r in con.execute(chat.oracle()).fetchall()}
    assert {c: tuple(r) for c, r in got.items()} == {c: r for c, r in want.items() if c != -1}
