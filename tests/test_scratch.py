"""What a job leaves on the disks while it goes on."""

import os

from pyspark.sql import functions as F

from corpuskit.operators import encode, sampling
from corpuskit.session import ensure_checkpoint_dir, forget, stored


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _tables(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("table-")}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    """what was shuffled for a table stayed beside it to the end of the job."""
    before = _shuffled(spark)
    table = stored(spark.range(1000).repartition(3, "id").withColumn("x", F.col("id") % 7))
    assert not _shuffled(spark) - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_only_stored_tables_are_forgotten(spark, tmp_out):
    spark.range(5).write.parquet(f"{tmp_out}/table-mine/in")
    given = spark.read.parquet(f"{tmp_out}/table-mine/in")
    before = _tables(spark)
    table = stored(given)
    assert len(_tables(spark) - before) == 1
    forget(table.join(given, "id"), given)
    assert _tables(spark) == before and given.count() == 5


def test_a_split_stores_no_column_of_its_order(spark):
    """the key's hash was a good part of the stored sentences."""
    rows = spark.createDataFrame([(i % 3 or None, f"s{i}") for i in range(20)], "k int, sent string")
    out = sampling.train_test_split(rows, ["k"], train_size=0.5)
    assert "_k" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.row_idx for r in out.where("split = 'train'").collect()) == list(range(10))


def test_decoding_shuffles_no_strings(spark):
    """all tokens were shuffled once more to bring rows of one key together."""
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, token string")
    rows = spark.createDataFrame([(None, [1, 2, 9]), (4, [2, 1])], "k int, ids array<int>")
    once = encode.decode(rows, vocab, ["k"])
    assert "collect_list" not in once._jdf.queryExecution().toString()
    assert {r.k: r.tokens for r in once.collect()} == {None: ["a", "b", None], 4: ["b", "a"]}
    again = encode.decode(rows.unionByName(spark.createDataFrame([(None, [3, 1]), (None, [9])], rows.schema)), vocab, ["k"])
    assert "collect_list" not in again._jdf.queryExecution().toString()
    assert {r.k: r.tokens for r in again.collect()} == {None: [None, "a", "c", "a", "b", None], 4: ["b", "a"]}
