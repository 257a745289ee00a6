from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat

ODD = st.text(alphabet=st.sampled_from('\\<>"lq/turn#\n a'), max_size=20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.read_turns(formatted) == turns


def test_each_reply_is_trained_on_once():
    turns = [{"turn": k, "role": r, "text": t} for k, (r, t) in enumerate([("system", "s"), ("user", "a"), ("assistant", "b<"), ("user", "c"), ("assistant", "\\d"), ("user", "end")])]
    got = list(chat.expand(turns))
    assert [x[0] for x in got] == [2, 4, None]
    assert [chat.unescape(f[a:b]) for _, f, a, b in got] == ["b<", "\\d", ""]
    assert got[1][1].startswith(got[0][1]) and chat.read_turns(got[-1][1])[-1] == ("user", "end")


def test_digests(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "yo"), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, None, "x"), (3, None, "user", "n")]
    got = {r["conv_id"]: r for r in chat.digest_examples(chat.expand_turns(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position int"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: (v["n_turns"], v["turns_sha256"], v["loss_chars"], v["loss_sha256"]) for k, v in got.items()} == {
        1: (2, sha("user\nyo\nassistant\nhi\n"), 2, sha("hi")), 2: (3, sha("user\n\nassistant\n\nassistant\n\n"), 0, sha("")), None: (1, sha("\nx\n"), 0, sha("")), 3: (1, sha("user\nn\n"), 0, sha("")),
    }
    assert chat.expand_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
