import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Names that the operators use inside, as columns of the documents.
CLASHES = ("uid", "w", "score", "pii_spans", "__doc", "__hash", "__t", "node", "root", "fp", "kept_doc", "hit_doc", "whole_text", "scored_text", "k", "bucket", "levels", "copies")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null and empty texts, repeated rows, one very long text, ties and clashing extra columns."""
    texts = [
        None, "", " ", "The cat sat on the mat and the dog sat on the log near the old red barn.", "the THE the", "a\\b <|im_end|> [INST] x",
        "call +49 (30) 1234-5678 or mail a.b@c.de_d@e.fr, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.25, GB82 WEST 1234 5698 7654 32",
        "x" * 3000 + " " + "ab " * 20000, "1" * 5000, "é" * 40 + " ￿ 4111111111111111 \U0001f600 a@b.co",
        "The cat sat on the mat and the dog sat on the log near the old red barn. Again the cat sat.", "1.2.3.4.5.6.7.8 000000012.1.1.1 12--34",
    ]
    extra = tuple(f"own {c}" for c in CLASHES)
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", len(t) if t else None, *extra) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(20, texts[3], "en", "s0", 1, *extra)], DOCS)
