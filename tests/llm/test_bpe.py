"""Byte-level BPE against the tiktoken library and exact round trips."""
import base64
import hashlib
import random

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from recordlake.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = None


def library():
    global LIBRARY
    if LIBRARY is None:
        with open(PATH, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return LIBRARY


def ids(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


TEXTS = ["", None, " ", "\n\n  \t x", "It's we'll THEY'RE 'd", "naïve  café  日本語テキスト 𝒳 🙂🙂", "a" * 5000, "ab" * 3000 + " " * 400, "\x1c\x85　 ​",
         "<|endoftext|> 123456789 3.14e-10 ----////", "The quick brown fox " * 50, "ſs ǅ İi ß " * 9, "\0\x7f�", "x" * 3 + "aaaaaaa baaab aab"]


def test_against_the_library(rows):
    df = rows([(i, t, 1.5, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 0.0, 1), (3, TEXTS[3], 1.5, 7)],
              "doc_id int, text string, n_tokens double, ids long")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(TEXTS) + 2
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    for r in out:
        want = library().encode_ordinary(texts[r["doc_id"]])
        assert ids(r["ids"]) == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst '1 \n\t"), st.characters(codec="utf-8")), max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    ranks, split = bpe._ranks(PATH), regex.compile(public_tokenizers.PATTERN)
    for t in texts:
        got = b"".join(ranks.known({w})[w] for w in split.findall(t))
        assert ids(got) == library().encode_ordinary(t)


def _plain(word, ranks):
    """The pair of lowest rank, the leftmost of equal ones, until none is left."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order(tmp_path):
    """Rank files in which a merge makes room for a pair of lower rank, as a plain loop has it."""
    rng = random.Random(3)
    for turn in range(30):
        tokens = [bytes([b]) for b in range(256)]
        more = {bytes(rng.choices(b"ab" if turn % 2 else b"abc", k=rng.randint(2, 6))) for _ in range(40)}
        more = sorted(more)
        rng.shuffle(more)
        path = tmp_path / f"{turn}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens + more)))
        ranks = bpe.Ranks(str(path))
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(60)] + [b"a" * 37, b"ab" * 20]
        assert [ids(w) for w in bpe.replay(words, ranks)] == [_plain(w, ranks.ranks) for w in words]


def test_small_blocks_and_slices(rows, monkeypatch):
    """Blocks, slices and memory of any size give the same ids."""
    text = " ".join(str(i * i) + "word" * (i % 5) for i in range(400)) + "   \n" + "z" * 90
    split, ranks = regex.compile(public_tokenizers.PATTERN), bpe.Ranks(PATH)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 30)
    got = [w for part in bpe.words(text, split) for w in part]
    assert got == split.findall(text)
    assert ids(b"".join(ranks.known({w})[w] for w in got)) == library().encode_ordinary(text)
    assert [w for part in bpe.words(" " * 333, split) for w in part] == split.findall(" " * 333)


def test_files_without_a_byte_are_refused(tmp_path):
    path = tmp_path / "short.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.Ranks(str(path))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = queries.op11(spark, folder).collect()
    assert len(out) == len(texts)
    for r in out:
        want = b"".join(i.to_bytes(4, "little") for i in library().encode_ordinary(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
