import hashlib

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvidex.llm import chat
from corvidex.llm.bpe import load_bytes

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", "[", "]", ">", "|", "/", "s", "a", "\n", "é"]), max_size=12).map("".join)


def digests(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(PIECES)
@example("<<s>\\<<SYS>><\\\\/s>")
def test_escaping_is_exact_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>"))
    assert chat.unescape_role(chat.escape_role(text)) == text


def test_mask_is_that_of_a_search_through_all_tokens():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 9), (9, 12)])
    for a in range(13):
        for b in range(a + 1, 13):
            touching = [i for i, (s, e) in enumerate(offsets) if s < b and e > a]
            first, last = chat.mask(offsets, [(a, b)])[0]
            assert [i for i in range(first, last) if offsets[i][0] < offsets[i][1]] == [i for i in touching if offsets[i][0] < offsets[i][1]]


LIBRARY = Tokenizer.from_file(public_tokenizers.path(chat.VOCABULARY))
LIBRARY.encode_special_tokens = True


@settings(max_examples=200, deadline=None)
@given(PIECES | st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=50) | st.text(alphabet="ab 's1\n\t é日\U0001f600\x1c\x85", max_size=50))
@example("日本語 \U0001f600🏽  x")
def test_ids_and_offsets_are_those_of_the_library(text):
    own, want = load_bytes(chat.VOCABULARY), LIBRARY.encode(text, add_special_tokens=False)
    ids = own.encode(text)
    assert ids.tolist() == want.ids
    offsets = own.offsets_of(text, ids)
    letters = [LIBRARY.id_to_token(i) for i in ids.tolist()]
    assert own.bytes_of[ids].tolist() == [len(x) for x in letters]
    raw, at = text.encode(), 0
    for (a, b), n in zip(offsets.tolist(), own.bytes_of[ids].tolist()):
        assert len(text[:a].encode()) <= at and at + n <= len(text[:b].encode()) and a < b
        at += n
    assert at == len(raw)


def test_a_turn_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 1000)
    monkeypatch.setattr(chat, "BATCH", 3000)
    turns = [("user", "q"), ("assistant", "long é " * 40_000), ("assistant", "x" * 100_000), ("user", " ")]
    df = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    segments = chat.format_conversations(df)
    for r in chat.read_back(segments).collect():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
    rows = segments.select("formatted", "ids", F.explode("loss").alias("l")).select("l.*").collect()
    assert len(rows) == 4 and all(0 <= r["straddling"] <= 2 for r in rows)


def test_query_against_the_table(spark, sf):
    rows = {r["conv_id"]: r for r in chat.op9_chat_format(spark, sf).collect()}
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, text FROM '{sf}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        by.setdefault(conv, []).append((role, text or ""))
    assert rows.keys() == by.keys()
    for conv, turns in by.items():
        r = rows[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
        assert r["formatted_chars"] >= sum(len(t) for _, t in turns)


def test_nulls_ties_odd_roles_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 40)
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (1, 2, "as\nsis\\n<s>", "\U0001f600é</s>\r\n\x00"), (1, 3, "assistant", " \U0001f600 日本 <s>\\</s>"), (None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"turn {k} </s> " * 3) for k in range(30)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS loss")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1] == digests([(r or "", t or "") for c, _, r, t in rows if c == 1])
    assert got[2] == digests([(r, t) for c, _, r, t in rows if c == 2])
    assert got[None] == digests([("user", "a"), ("user", "a"), ("user", "b")])
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0
