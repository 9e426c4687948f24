"""From raw documents to training shards: five stages, each one of the library's corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. Every row is decided by its own text, whether its id is null or repeated. All but the last keep the columns of documents.

1. toxicity: documents predicted toxic go.
2. near_duplicates: one document of each near-duplicate component stays, the one with the smallest doc_id.
3. decontamination: documents that hold a phrase of the benchmark go.
4. mixing: sources stand at their target weights; those below them are repeated, none is cut.
5. token_shards: token sequences at keyed random slots of binary shards; a row for each sequence. Repeats of a document go to
   places of their own, so every stretch of slots holds the sources at their weights but for chance.

Edge cases: a null or empty text is clean, no copy of another and one end token; of rows that are equal in id and text one stays
(all do if their text has no words); a null source is a source of its own; empty tables give no rows; stages keep all columns of their input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slackline.llm import decontaminate, minhash, mixing, toxicity, training_order
from slackline.llm.tables import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remixed(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_order.training_shards(docs, spread=True)  # repeats that mixing made stand apart


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]

#: The toxicity scores come from a model that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
