import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, catalog, token_files, token_packing
from strandlake.llm.common import fresh_path

ODD = [None, "", " \n\t", "Hello, World! it's  we'll 123", "a\x1cb \x85 c", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ. İstanbul", "é ́x 한국어 漢字 😀😀", "x" * 30000, "word " * 20000, " a　b​", "Ê ÊÊ ñ's"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src0") for i, t in enumerate(ODD)] + [(3, ODD[3], "src0"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.WORD_VOCABULARY)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def corpus(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_token_files_match_the_library(spark, sf_dir):
    want, at = {}, 0
    docs = sorted(corpus(spark, sf_dir))
    for (d, _), ids in zip(docs, word_ids([t for _, t in docs])):
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.op6_token_files(spark, sf_dir).collect()} == want


def test_token_files_of_odd_rows(spark, odd):
    rows = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.op6_token_files(odd, catalog.WORD_VOCABULARY).collect()), key=lambda r: (r[0], r[2]))
    order = [(None, "no id"), *sorted(((i, t or "") for i, t in [*enumerate(ODD), (3, ODD[3])]), key=lambda r: r[0])]
    at = 0
    for got, (d, _), ids in zip(rows, order, word_ids([t for _, t in order]), strict=True):
        assert got[1:] == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_reader_takes_only_what_is_wanted_and_sees_damage(spark, odd, tmp_path):
    folder = fresh_path(spark, "some")
    manifest = token_files.write_token_files(odd, folder, catalog.WORD_VOCABULARY)
    got = {r.doc_id: r.ids for r in token_files.read_token_files(manifest, folder, [4, 9]).collect()}
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in got.items()} == dict(zip((4, 9), word_ids([ODD[4], ODD[9]])))
    path = tmp_path / "one"
    with open(path, "wb") as f:
        w = token_files.FrameWriter(f)
        w.add(7, b"abcd" * 10)
        w.close()
    raw = bytearray(path.read_bytes())
    raw[12] ^= 1
    path.write_bytes(raw)
    import pyarrow as pa

    with pa.OSFile(str(path)) as f, pytest.raises(Exception):
        token_files.FrameReader(f).content(0)


def check_packing(rows, docs):
    by, place = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (d, t), ids in zip(docs, word_ids([t for _, t in docs])):
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s, got in place.items():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at == 2048 or s == max(place)


def test_packing(spark, sf_dir, odd):
    check_packing(catalog.op10_packing(spark, sf_dir).collect(), corpus(spark, sf_dir))
    once = odd.dropDuplicates(["doc_id"])
    check_packing(token_packing.op10_packing(once, catalog.WORD_VOCABULARY).collect(), [(r.doc_id, r.text) for r in once.collect()])


def test_sequences_hold_all_ids(spark, odd):
    pieces = token_packing.pack(token_packing.encode_documents(odd, catalog.WORD_VOCABULARY), window=64)
    whole = token_packing.sequences(pieces).collect()
    assert all(s.n_tokens == 64 for s in whole if s.sequence_id != max(x.sequence_id for x in whole))
    assert sum(s.n_tokens for s in whole) == sum(map(len, word_ids([*ODD, ODD[3], "no id"])))


def test_empty_tables(spark, odd):
    none = odd.filter(F.lit(False))
    assert token_files.op6_token_files(none, catalog.WORD_VOCABULARY).collect() == []
    assert token_packing.op10_packing(none, catalog.WORD_VOCABULARY).collect() == []
    assert byte_bpe.op7_byte_bpe(none, catalog.BYTE_RANKS, P.PATTERN).collect() == []


def tik():
    import tiktoken

    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(catalog.BYTE_RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_matches_tiktoken(spark, sf_dir, odd):
    t = tik()
    for docs, rows in ((corpus(spark, sf_dir), catalog.op7_byte_bpe(spark, sf_dir).collect()), ([*enumerate(ODD), (None, "no id")], byte_bpe.op7_byte_bpe(odd, catalog.BYTE_RANKS, P.PATTERN).collect())):
        want = {}
        for d, text in docs:
            ids = t.encode_ordinary(text or "")
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_every_token_merges_to_itself():
    c = byte_bpe.coder(catalog.BYTE_RANKS, P.PATTERN)
    mapped = [t.decode("latin-1").translate(c.mapped) for t in c.tokens]
    wrong = [i for i, ids in enumerate(c.library.encode(mapped, num_threads=1)) if ids != [i]]
    assert not wrong, wrong[:5]
