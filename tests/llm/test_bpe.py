import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curatrix.llm import bpe

from awkward_rows import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts(n):
    rng = random.Random(5)
    pools = [list("abcdeth  \n'sre1,"), [chr(c) for c in range(0x20, 0x250)], [chr(c) for c in range(0x3040, 0x3100)], ["<|endoftext|>", " ", "a", "\t"]]
    return ["".join(rng.choice(pools[k % 4]) for _ in range(rng.randint(0, 80))) for k in range(n)]


def test_encoder_counter_and_decoder_agree_with_the_library(merges, library):
    e, c, d = bpe.Encoder(merges), bpe.Counter(merges), bpe.Decoder(merges)
    for t in _texts(800):
        ids = library.encode(t, add_special_tokens=False).ids
        packed = e.encode(t)
        assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == ids
        assert c.count(t) == len(ids)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == t


def test_transducer_emits_early_and_keeps_little(merges, library):
    rng = random.Random(1)
    tokens = [b.decode() for b in merges.of_bytes if b.isascii() and b.isalpha()]
    hostile = ["".join(rng.choice(tokens)[::-1] for _ in range(8000)), "".join(rng.choice("aeiounst") for _ in range(30_000))]
    for word in [u * 9000 for u in ("a", "xyzzy", "the", "é", "aA", "lolol")] + hostile:
        t = bpe.Transducer(merges)
        early, want = list(t.feed(word.encode())), library.encode(word, add_special_tokens=False).ids
        assert early + t.finish() == want
        assert len(early) > 0.9 * len(want) and t.held <= 2 * t.ahead + merges.longest + 1 < 1000


def made_list(rng, n):
    """A merge list over three bytes, every pair after those that make its sides."""
    tokens, pairs = [bytes([b]) for b in range(256)], []
    while len(pairs) < n:
        known = [i for i, t in enumerate(tokens) if set(t) <= set(b"abc") and len(t) < 7]
        a, b = rng.choice(known), rng.choice(known)
        if tokens[a] + tokens[b] not in tokens:
            tokens.append(tokens[a] + tokens[b])
            pairs.append((a, b, len(tokens) - 1))
    return tokens, pairs


def merged(text, pairs):
    """The merges one after the other, each from the left."""
    out = list(text)
    for a, b, c in pairs:
        i = 0
        while i < len(out) - 1:
            if out[i : i + 2] == [a, b]:
                out[i : i + 2] = [c]
            i += 1
    return out


def test_lookahead_is_sufficient_for_any_list():
    rng, changed = random.Random(8), 0
    for _ in range(60):
        tokens, pairs = made_list(rng, rng.randint(1, 25))
        m = bpe.Merges(tokens, pairs, {})
        for _ in range(30):
            text = bytes(rng.choice(b"abc") for _ in range(60))
            whole = merged(text, pairs)
            t = bpe.Transducer(m)
            assert [*t.feed(text), *t.finish()] == whole
            ends, at = set(), 0
            for x in whole:
                ends.add(at := at + len(tokens[x]))
            for cut in range(1, 60):
                at = 0
                for x in merged(text[:cut], pairs):
                    at += len(tokens[x])
                    if at not in ends:
                        changed += 1
                        assert cut - at < m.lookahead
    assert changed > 1000


def test_pairs_out_of_order_are_refused():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    with pytest.raises(ValueError):
        bpe.Merges(tokens, [(256, 99, 257), (97, 98, 256)], {})


def test_decoder_holds_back_open_characters_and_replaces_broken_ones(merges):
    d = bpe.Decoder(merges)
    ids = [merges.byte_ids[b] for b in "é😀".encode()]
    assert [d.feed([i]) for i in ids] == ["", "é", "", "", "", "😀"]
    assert d.feed([merges.byte_ids[0xC3]]) == "" and d.finish() == "�"


def test_rows(spark, awkward, empty, library):
    got = bpe.encode_texts(awkward, PATH).select("doc_id", bpe.ids_array("ids").alias("ids"), "decoded").collect()
    assert sorted((r.doc_id or 0, r.decoded, tuple(r.ids)) for r in got) == sorted((i or 0, t or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    n = bpe.count_tokens(awkward, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in n) == sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    assert bpe.encode_texts(empty, PATH).count() == bpe.count_tokens(empty, PATH).count() == 0
