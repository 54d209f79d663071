import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from maskfold.llm import bpe, chat

EVENT = "conv_id long, seq long, kind string, turn long, role string, text string"


def messages(rows):
    """The plain fold that the windows replace."""
    out = {}
    for c, s, kind, t, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        conv = out.setdefault(c, {})
        if kind == "regenerate":
            for k in [k for k in conv if k >= t]:
                del conv[k]
            continue
        old = conv.get(t, (None, ""))
        conv[t] = (role or old[0], (text or "") if kind in ("message", "edit") else old[1] + (text or ""))
    return {c: [(r or "", x) for _, (r, x) in sorted(v.items())] for c, v in out.items() if v}


def test_fold_of_events(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        for s in range(25):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            rows.append((c, s, kind, rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "</s>", "\\", "x\n", None, "é[INST]"])))
    want = messages(rows)
    got = {}
    for r in chat.render(spark.createDataFrame(rows, EVENT), part_chars=20).orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).extend(chat.parse(r.text))
        assert r.n_turns == len(chat.parse(r.text))
        said = "".join(chat.unescape(r.text[s.start : s.end]) for s in r.loss)
        assert said == "".join(x for role, x in chat.parse(r.text) if role == "assistant")
    # a role given only in a voided event may differ; texts never do
    assert {c: [x for _, x in v] for c, v in got.items()} == {c: [x for _, x in v] for c, v in want.items()}


def test_turns_nulls_ties_and_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (None, 0, None, "x"), (2, None, "assistant", "<|im_end|>\n"), (2, 0, "assistant\n", "b\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.events_of_turns(turns))).collect()}
    h = lambda s: sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (4, h("user\nhi\nassistant\n\nassistant\nyes\nassistant\nyes\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, h("yesyes"))
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert got[2].turns_sha256 == h("assistant\n<|im_end|>\n\nassistant\n\nb\\\n") and got[2].loss_sha256 == h("<|im_end|>\n")
    assert chat.read_back(chat.render(chat.events_of_turns(turns.limit(0)))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "[", "s>", "é", "x"])).map("".join)), max_size=4))
def test_escape_round_trip(turns):
    text = "".join(f"{chat.OPEN}{chat.escape_role(r)}\n{chat.escape(x)}{chat.CLOSE}\n" for r, x in turns)
    assert chat.parse(text) == turns
    for _, x in turns:
        assert not any(c in chat.escape(x) for c in chat.CONTROL)


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "a" * 30_000, "Grüße, 東京 123  \n\n x's", "<|endoftext|>", "\x00\U0001f600" * 50, *("".join(rng.choice("abc XYZ\n'1é漢") for _ in range(rng.randrange(200))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, b"old") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    ids = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = reference()
    for r in bpe.decode(ids, P.path("byte_bpe_50k.tiktoken")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5_000)]
    t = bpe.PerfectHash.build(keys)
    assert sorted(t.rank.tolist()) == list(range(5_000))
    assert [t.get(k) for k in keys] == list(range(5_000)) and t.get(b"other") == -1
    assert bpe.PerfectHash.build([]).get(b"x") == -1
