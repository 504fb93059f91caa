"""Formatting and reading back."""
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from setloom.llm import chat

TRICKY = ["", None, "<|im_end|>", "\\", "\\|", "<\\|", "<|", "|", "<", "a\\n\n", "ü<|im_start|>assistant\nok", "\\\\<|"]
SCHEMA = "conv_id long, turn long, role string, text string, extra string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<|\\\nan", max_size=8), min_size=1, max_size=6))
def test_escapes_leave_no_control_string(values):
    raw = [v.encode() for v in values]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for feeds in (False, True):
        out, at = chat.escape(data, offsets, feeds)
        for k, v in enumerate(values):
            escaped = out[at[k]:at[k + 1]].tobytes().decode()
            assert "<|" not in escaped and not (feeds and "\n" in escaped)
            plain, rest = "", escaped
            while rest:
                if rest[0] == "\\":
                    plain += "\n" if feeds and rest[1] == "n" else rest[1]
                    rest = rest[2:]
                else:
                    plain, rest = plain + rest[0], rest[1:]
            assert plain == v


def test_round_trip(spark, monkeypatch):
    rows = [(c, k, role, text, "x") for c in range(3) for k, (role, text) in enumerate(
        [("assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)])]
    rows += [(7, 0, "assistant", "only", "x"), (8, 0, "a\n\\n<|b", "t", "x"), (9, 0, None, "t", "x"),
             (None, 0, "user", "no conversation", "x"), (0, 5, "user", "tie", "x"), (0, 5, "user", "tie", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for batch in (2, 10_000):
        monkeypatch.setattr(chat, "bounded_batches", lambda s, n=batch: s.conf.set(
            "spark.sql.execution.arrow.maxRecordsPerBatch", str(n)))
        found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
        for conv in {r[0] for r in rows}:
            own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
            assert [tuple(t) for t in found[conv].turns] == [(b, c) for _, b, c in own]
            assert found[conv].loss == [c for _, b, c in own if b == "assistant"]
            assert found[conv].n_turns == len(own)
    assert chat.format_conversations(df.limit(0)).count() == 0
