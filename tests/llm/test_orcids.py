import zlib

import numpy as np
import pyarrow.orc as orc

from oscilla.llm import orcids, wordbpe
from oscilla.llm.common import fresh_path


def slow(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wordbpe.tokenizer_path())
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(orcids.orc_round_trip(docs)) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(5, "b"), (1, None), (None, "x"), (3, ""), (7, "Same. Text"), (7, "Same. Text"), (9, "long " * 20000), (11, "<|endoftext|>"), (12, "a<|startoftext|>b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    assert got(orcids.orc_round_trip(docs)) == slow(rows)
    assert orcids.orc_round_trip(docs.where("false")).count() == 0


def scanned(df):
    """Rows that the scans of a collected query read."""
    rows = df.collect()
    plan, n = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "Scan orc" in node.nodeName():
            n += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
    return len(rows), n


def test_file_has_stripes_indexes_and_filters_that_prune(spark):
    """Footers: several stripes, a row index and a Bloom filter of doc_id, integers run-length encoded; scans read a row group at most, or nothing."""
    docs = spark.createDataFrame([(i, f"word {i} and {i * 7919 % 1000} more of them") for i in range(0, 40_000, 2)], "doc_id long, text string").coalesce(1)
    path = fresh_path(spark, "orc-test")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    orcids.write_ids(docs, path, wordbpe.tokenizer_path(), stripe_bytes=1 << 16)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    import glob

    files = glob.glob(f"{path.removeprefix('file://')}/*.orc")
    assert sum(orc.ORCFile(f).nrows for f in files) == 20_000 and all(orc.ORCFile(f).compression == "ZSTD" for f in files)
    jvm = spark._jvm
    conf, stripes = spark._jsc.hadoopConfiguration(), 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, columns = reader.rows(), list(reader.getSchema().getFieldNames())
        for stripe in reader.getStripes():
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            kinds = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            own = columns.index("doc_id") + 1
            assert (own, "ROW_INDEX") in kinds and (own, "BLOOM_FILTER_UTF8") in kinds
            assert {footer.getColumns(c).getKind().toString() for c in range(own, footer.getColumnsCount())} == {"DIRECT_V2"}
        rows.close()
    assert stripes >= 2
    stored = orcids.read_ids(spark, path)
    found, read = scanned(stored.where("doc_id = 4000"))
    assert found == 1 and read <= 1000
    # within every range of ids: only a Bloom filter can tell that it is not there
    absent = [scanned(stored.where(f"doc_id = {i}")) for i in range(4001, 4041, 2)]
    assert all(n == 0 for n, _ in absent) and sum(read == 0 for _, read in absent) >= 15
