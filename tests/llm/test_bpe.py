"""Byte-level BPE against the library that the rank files are made for."""

import base64
import hashlib
import random
import unicodedata

import pyarrow as pa
import pytest
import public_tokenizers as public
import tiktoken

from corpusloom.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(library, texts):
    code = bpe.Coder(PATH)
    ids, offsets = code.encode(pa.array(texts, pa.string()))
    data, cuts = code.decode(ids, offsets)
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode_ordinary(text or ""), repr(text)
        assert data[cuts[i]:cuts[i + 1]].tobytes() == (text or "").encode()


CASES = [
    "", None, " ", "  ", "\n", " \n", "a", " a", "  a", "a ", "a  ", "\ta", "\n a", " \na", "it's", "'s", "'s's", " 's", "\n's", "!'s", "'re", "'r", "'", "''",
    "'ll'll", "x'lly", "'sx 'tx", "don't   we'll", "a1b2  33", "ñandú 12½", "a\x1cb", "a\x85 b", "a b  c", "😀😀 x", "日本語テキスト", "<|endoftext|>",
    "...\n\n\n", "...\n\n\nx", "ab" * 5000, "a" * 3000, " " * 1000 + "x", "é" * 500, "é", "'S 'T", "''s", "1's", "a's1", "’s",
]


def test_cases(library):
    check(library, CASES)
    for text in CASES:
        check(library, [text])


def test_random_mixtures(library):
    rng = random.Random(5)
    alphabet = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", " ", "\n", "\t", " ", "1", "½", "!", "é", "日", "😀", "A", "."]
    check(library, ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)])


def test_every_assigned_code_point(library):
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)} " for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    check(library, texts)


def test_blocks_meet(library):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", " ", "'s", "\n", "1", "?"], k=n)) for n in (bpe.BLOCK - 1, bpe.BLOCK, bpe.BLOCK + 1, 5 * bpe.BLOCK, 20_000)]
    check(library, texts)


def test_digest_and_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want)
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "token_ends"]
    for r in coded.collect():
        raw, at = (CASES[r.doc_id] or "").encode(), 0
        assert r.token_ends[-1:] == ([len(raw)] if raw else [])
        for token, end in zip(r.ids, r.token_ends):
            assert library.decode_single_token_bytes(token) == raw[at:end]
            at = end
    assert sorted((r.doc_id, r.text) for r in bpe.decode(coded, PATH).collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert bpe.digest(docs.limit(0), PATH).count() == 0
