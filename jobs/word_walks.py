"""Word walks, streaming: a Markov chain for each source of a growing table of texts, next to that of its language.

A text is a discrete trajectory: its words (runs of other than space and the controls 09-0D) are snapshots, and the state
of a word is the class of its length in code points: class k for edges[k] <= length < edges[k + 1], the last class for
all that is longer. The chain of a source, and the pooled one of its language, are estimated from all transitions over
lag words; comparing them is the block test of a model: ensembles that follow one chain have like rows.

Files of the table (doc_id, text, lang, source) are a stream: each run takes those that its checkpoint has not seen,
at most "files" in a batch, and ends when there are none left. Tables in the output folder:
  counts/batch=...    lang, source, from_state, to_state, n of one batch, replaced if the batch is repeated
  chains/lang=...     source, from_state, to_state, n, p (share of n in the source's row), p_lang (the same of the whole
                      language); made from all batches after the stream has ended
  checkpoint          Spark's, of the stream

A run that is repeated, after success or in the middle, gives the same tables. Null and empty lang or source are
"(none)"; texts that are null or have at most lag words have no transitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, found, logger
from weftline.operators import trajectories

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
COUNTS = "lang string, source string, from_state bigint, to_state bigint, n bigint, batch bigint"
CHAINS = "source string, from_state bigint, to_state bigint, n bigint, p double, p_lang double, lang string"
WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
log = logger("word_walks")


def length_class(length: Column, edges: list[int]) -> Column:
    """Number of the class of a length; lengths below the first edge belong to the first class."""
    return sum(((length >= e).cast("long") for e in edges[1:]), F.lit(0).cast("long"))


def transitions(docs: DataFrame, edges: list[int], lag: int) -> DataFrame:
    """(lang, source, from_state, to_state, n) of texts."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NONE)).alias(c)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    walks = docs.select(named("lang"), named("source"), F.transform(words, lambda w: length_class(F.char_length(w), edges)).alias("states"))
    return trajectories.count_array_pairs(walks, F.col("states"), lag, ("lang", "source"))


def chains(counts: DataFrame) -> DataFrame:
    """CHAINS of the counts (lang, source, from_state, to_state, n) of any number of batches."""
    rows = counts.groupBy("lang", "source", "from_state", "to_state").agg(F.sum("n").alias("n"))
    pooled = rows.groupBy("lang", "from_state", "to_state").agg(F.sum("n").alias("m"))
    pooled = trajectories.normalized(pooled, ["lang", "from_state"], "m", "p_lang").drop("m")
    rows = trajectories.normalized(rows, ["lang", "source", "from_state"], "n").join(pooled, ["lang", "from_state", "to_state"])
    return rows.select("source", "from_state", "to_state", "n", "p", "p_lang", "lang")


def as_pattern(path: str) -> str:
    """A pattern that fits only path: a stream takes folders and patterns, but not the path of a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, config: dict) -> dict:
    """Takes the new files of config["input"] into the tables of config["output"]; returns what it read and wrote."""
    out = config["output"].rstrip("/")
    done = {"batches": 0, "read": 0, "written": 0}

    def take(batch: DataFrame, number: int) -> None:
        path, n = f"{out}/counts/batch={number}", batch.count()  # of Parquet files, from their footers
        transitions(batch, config["edges"], config["lag"]).write.mode("overwrite").parquet(path)
        done["batches"] += 1
        done["read"] += n
        log.info("batch %d of %d texts is in %s", number, n, path)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files"]).parquet(as_pattern(config["input"]))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = found(spark, f"{out}/counts", COUNTS)
    if counts is None:
        log.info("%s holds no file: nothing to do", config["input"])
        return done
    # From all counts, which are few, also where no file was new: a run before may have ended between the two.
    rows = chains(counts).repartition("lang", "source")
    rows.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/chains")
    done["written"] = chain_table(spark, config).count()
    log.info("read %d texts of %s in %d batches, wrote %d rows of chains", done["read"], config["input"], done["batches"], done["written"])
    return done


def chain_table(spark: SparkSession, config: dict) -> DataFrame:
    """All chains as they stand."""
    return spark.read.schema(CHAINS).parquet(f"{config['output'].rstrip('/')}/chains").select("lang", "source", "from_state", "to_state", "n", "p", "p_lang")


if __name__ == "__main__":
    command_line("word_walks", run, __doc__.split("\n")[0])
