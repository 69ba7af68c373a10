"""The making of places is spread by rows, whatever the files of the table are."""

import numpy as np
import pyarrow as pa

from waymark.operators import index
from waymark.plans import fixture as X


def test_one_group_of_rows_is_several_tasks(spark, monkeypatch, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(X, "ROWS_OF_TASK", 10)
    rows = X.place_vectors(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= source.count() // 10
    assert rows.count() == source.where("vec_id >= 16 and vec_id % 10 <> 9").count()


def test_vectors_as_a_matrix():
    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]]), pa.array([[5.0, 6.0]])])
    assert index.matrix_of(column).tolist() == [[1, 2], [3, 4], [5, 6]]
    assert index.matrix_of(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[3, 4]]
    assert index.BATCH * index.HUB_ROWS * np.dtype(float).itemsize < 8 << 20
