"""The stateless chain gives the same rows on a stream as in batch."""
import os
import tempfile

from parallax.sources import tables as T
from parallax.streaming import clean as SC
from conftest import SF001


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="parallax-stream-")
    src = os.path.join(d, "in")
    T.v_bitext(spark, SF001).write.parquet(src)
    schema = "pair_id long, src string, tgt string"
    q = (SC.clean_stream(spark, src, schema, ["src", "tgt"]).writeStream.format("memory")
         .queryName("parallax_clean").option("checkpointLocation", os.path.join(d, "chk")).start())
    q.processAllAvailable()
    q.stop()
    streamed = {tuple(r) for r in spark.sql("SELECT * FROM parallax_clean").collect()}
    batch = SC.clean_columns(spark.read.parquet(src), ["src", "tgt"])
    from parallax.functions.text import n_tokens
    batch = batch.withColumns({"n_tokens_src": n_tokens("src"), "n_tokens_tgt": n_tokens("tgt")})
    assert streamed == {tuple(r) for r in batch.collect()} and len(streamed) > 0
