"""The registered queries over whole tables, held against brute force of their contracts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
from tests.llm.test_repeats import brute_bytes, brute_words
from tests.llm.test_similar import brute_signatures, components

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return {r[0]: r for r in contract.queries()[name](spark, SF).collect()}


def test_op1(spark, texts):
    got, order, prints = run(spark, "op1_simhash"), sorted(texts), []
    for i in order:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), texts[i].encode()))
        shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    near = [(a, b) for a in range(len(order)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = components(len(order), near)
    assert len(got) == len(order)
    for k, i in enumerate(order):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[k]:016x}", order[label[k]])


def test_op3(spark, texts):
    got = run(spark, "op3_toxicity")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_op4(spark, texts):
    got, order = run(spark, "op4_spotsigs"), sorted(texts)
    assert got.keys() == texts.keys()
    for i, after in zip(order, order[1:] + order[:1]):
        t, cut = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - cut] + texts[after][:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited.encode()))
        assert got[i].edited_fingerprint == "".join(f"{x:08x}" for x in sorted(brute_signatures(edited)))


def test_op5(spark, texts):
    got, want = run(spark, "op5_suffix_dedup"), brute_bytes(sorted(texts.items()), 400)
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {i: (*w[:3], sha(w[3])) for i, w in want.items()}


def test_op6(spark, texts):
    got = run(spark, "op6_secrets")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in texts.items():
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6 and m[1].isascii()]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c))
        assert tuple(got[i])[1:5] == (len(a), len(b), len(c), sha(base.encode()))
        assert {s for s in base.split(",") if s} <= set(got[i].spans.split(","))


def test_op7(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    order = sorted(rows)
    x = np.array([rows[i] for i in order], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = components(len(order), list(zip(*np.nonzero(near))))
    got = run(spark, "op7_embeddings")
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(near[k].sum()) - 1, order[label[k]], label[k] == k) for k, i in enumerate(order)}


def test_op8(spark, texts):
    got, want = run(spark, "op8_substring"), brute_words(sorted(texts.items()), 20)
    assert {i: tuple(r)[1:4] for i, r in got.items()} == {i: (w[0], w[1], sha(w[2].encode())) for i, w in want.items()}


def test_op10(spark, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in run(spark, "op10_sentencepiece").items():
        ids = library.encode(texts[i])
        assert tuple(r)[1:4] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))
        # A piece covers its own bytes, a byte piece one, and the space put before the text none.
        sizes = [1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.replace("\u2581", " ").encode()) for p in map(library.id_to_piece, ids)]
        if "\u2581" not in texts[i]:
            assert r.ends_sha256 == sha((np.cumsum(sizes) - 1).astype("<i4").tobytes())
