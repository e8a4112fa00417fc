"""A corpus pipeline of five stages, each over all that its predecessor kept."""

from strata.llm import op1_mixing, op2_quality, op5_packing, op9_jaccard, op10_toxicity
from strata.llm.common import checkpoint_dir

STAGES = [
    ("toxicity", op10_toxicity.stage),
    ("quality classifier", op2_quality.stage),
    ("n-gram Jaccard join", op9_jaccard.stage),
    ("mixing sources to target weights", op1_mixing.stage),
    ("best-fit packing", op5_packing.stage),
]
#: Trained models and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each result is written as Parquet and read again."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
