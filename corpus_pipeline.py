"""The corpus pipeline: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of `documents`:

1. quality rules: rejected documents go;
2. line dedup: lines that an equal or nearly equal one precedes leave the texts;
3. near-dedup over shingles of five words: of each group the document
   with the smallest id stays;
4. mixing: the rows are sorted by the sources' schedule, none is lost;
5. SentencePiece: the pieces of each text, with its mix_position in the schedule.

Files don't keep the order of rows, so the last stage takes the schedule again
from what mixing kept: ids, sources and counts give the same places.

`run` applies the stages to `documents`, each written as Parquet and read again.
Where the table is empty, so is every stage's result. Null texts have no words,
which the first stage rejects; null ids come before all others. Rows that repeat
are one document from the third stage on, and rows that share an id but not
their text are documents of their own, in the order of a hash of the text. Ties
in the schedule are broken by hash, id and text. Columns of any name are carried
along to the last stage, which returns ids, pieces and places; of the input's
columns those named like the ones that mixing adds (`mix_source` and the like)
don't reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm import line_dedup, mixing, quality, sentence_pieces, simhash
from shotlake.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs, shortest=line_dedup.SHORTEST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.filtered(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).orderBy("mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(mixing.mix(docs), carried=("mix_position",), counted=docs)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_repeats),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("sentence_pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
#: DuckDB SQL for run()'s rows: schedules, edit joins and piece folds have none.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
