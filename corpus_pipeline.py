"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again for the next one. All but the last return the columns of ``docs``.
"""

from spectralake.llm import decontamination, language_id, mixing, ngram_join, secrets
from spectralake.session import ship
from spectralake.storage import save


def language(spark, docs, sf_dir):
    """Texts without a letter, or whose words are of no language the model is sure of, go; mixes of known ones stay."""
    ship(spark)
    return language_id.known(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked ones stays: that with the smallest doc_id."""
    ship(spark)
    return ngram_join.representatives(docs)


def benchmark_overlap(spark, docs, sf_dir):
    """Documents with a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced by a mark; all documents stay."""
    ship(spark)
    return secrets.redacted(docs)


def source_mix(spark, docs, sf_dir):
    """The mix: the words of which documents, and which of them, go to which slot of which output shard."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_overlap),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
]

# The fields of the first and fourth stage are trained models: no SQL gives their rows.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
