import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concourse.llm import records as rec

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "Hello world.\nNew  line\t<|endoftext|> é中🙂"), (1, None), (2, ""), (None, "no id"), (9, "a b " * 20_000),
        (9, "same id"), (9, "same id"), (-5, "negative\n"), (12, " lead"), (13, "trail "), (14, "x y"), (15, "don't I'll\r\n")]


def test_round_trip(make_docs, monkeypatch):
    monkeypatch.setattr(rec, "FILE_ROWS", 3)
    import zlib
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rec.record_round_trip(make_docs(ROWS), PATH).collect())
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = {}
    for i, t in ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [g[1] for g in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    start = 0
    for s, i, n, crc in got:
        assert s == start and (n, crc) in want[i]
        start += n


def test_whole_table_equals_the_library(spark):
    import zlib
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rec.record_round_trip(docs, PATH).collect()}
    start, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_folder_is_where_spark_writes(spark, tmp_path):
    assert rec.shared_uri(spark, str(tmp_path)) == rec.shared_uri(spark, f"file:{tmp_path}") == f"file://{tmp_path}"


def test_files_and_random_reads(make_docs, tmp_path):
    folder = f"file://{tmp_path}/rec"
    files = rec.write_records(make_docs(ROWS), PATH, folder).collect()
    assert sum(f.records for f in files) == len(ROWS)
    f = rec.RecordFile(rec.file_base(folder, files[0].file))
    ids = [f[i][0] for i in reversed(range(len(f)))][::-1]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert not [p for p in (tmp_path / "rec").iterdir() if p.suffix not in (".rec", ".idx")]


def test_damage_is_found():
    good = rec.pack(7, np.array([1, 2, 70_000], np.uint32), 4)
    assert rec.unpack(good)[0] == 7 and rec.unpack(good)[1].tolist() == [1, 2, 70_000]
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            rec.unpack(bytes(bad))


def test_empty(make_docs):
    assert rec.record_round_trip(make_docs([]), PATH).count() == 0
