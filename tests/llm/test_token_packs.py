import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from goldsieve.llm.token_packs import Pack, build_pack, id_bits, pack_bits, packed_tokens, unpack_bits
from goldsieve.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bits_round_trip():
    assert [id_bits(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]
    rng = np.random.default_rng(3)
    for bits in (1, 3, 7, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
        packed = pack_bits(ids, bits)
        assert len(packed) == -(-1001 * bits // 8)
        assert (unpack_bits(packed, 1001, bits) == ids).all()


def test_pack_gives_any_range_and_checks():
    rng = np.random.default_rng(4)
    counts = [1, 9000, 0, 20_000, 3]
    ids = rng.integers(0, 49_408, sum(counts)).astype("<u4")
    pack = Pack(build_pack([5, None, 7, 8, 9], counts, ids, 16))
    assert pack.keys == [5, None, 7, 8, 9]
    for start, stop in ((0, 1), (0, len(ids)), (8191, 8193), (17_000, 17_000), (100, 25_000)):
        assert (pack.ids(start, stop) == ids[start:stop]).all()
    ends = np.cumsum(counts)
    wanted = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts)]
    assert pack.checks() == wanted


def test_word_by_word_is_the_whole_tokenizer():
    whole, encoder, rng = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(1)
    alphabet = "aAé ÉİıßŒǅ\t\n\r\x0b\x1c\xa0́'sve.,!|12三ΣςK <|endoftext|>ﬁ"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        wanted = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == wanted, text


def _wanted(rows, end_id=2):
    whole, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def _rows(df):
    found = df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted((tuple(row) for row in found), key=lambda row: row[1])


def test_documents_in_key_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    rows = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    assert _rows(packed_tokens(docs, PATH)) == _wanted(rows)


def test_odd_rows_and_none(odd_docs):
    rows = [(row["doc_id"], row["text"]) for row in odd_docs.select("doc_id", "text").collect()]
    assert _rows(packed_tokens(odd_docs, PATH)) == _wanted(rows)
    assert packed_tokens(odd_docs.where("false"), PATH).count() == 0
