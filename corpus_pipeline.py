"""A training corpus from documents: five stages, each written as Parquet and read by the next.

Rows are known by id and text, so a row is never removed for another's text. Defined cases, for every stage: a
null text is empty; rows without an id, and rows of one id with different texts, are judged each for itself;
equal rows are judged alike, and the near-duplicate stage keeps one of them; an empty table gives an empty table; columns
beyond those of documents pass through unread, whatever their names."""

from pyspark.sql import functions as F

from plotlink.llm import decontaminate, jaccard_tree, line_templates, packing, quality_rules
from plotlink.llm.common import free, new_path, numbered, same


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    verdicts = quality_rules.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept_documents(docs, verdicts)


def lines(spark, docs, sf_dir):
    """Documents less the lines of recurring templates; ``n_chars`` follows the text."""
    out = line_templates.without(docs, line_templates.dropped_lines(docs))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark, docs, sf_dir):
    """One document of each group, that of the smallest doc_id; of repeated rows one. Documents without an id of
    their own (null, or shared with another text) come after all others, by a hash."""
    node = free(docs, "_node")
    rows = numbered(docs, node)
    classes = jaccard_tree.jaccard_join(rows, k=5, num=80, den=100, id_col=node)
    gone = classes.filter(~same(F.col("doc_id"), F.col("component_id"))).select("doc_id")
    # texts travel once: what goes and what is a repeated row are both found where a number's rows are together
    number = free(rows, "_number")
    return rows.repartition(node).join(gone.toDF(number).distinct(), F.col(node) == F.col(number), "left_anti").dropDuplicates([node]).drop(node)


def benchmark(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark, docs, sf_dir):
    """The pieces of all documents with their places in training sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: The stages train, parse and solve; SQL can't express them, tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage over all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
