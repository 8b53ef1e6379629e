"""The property graph: labels, relationship types and schemas."""

from pyspark.sql import types as T

# The closed vocabularies of the graph.
LABELS = ["Paper", "Author", "Topic", "Method", "Dataset", "Institution", "Claim", "Community", "Metric"]
RELATIONSHIPS = [
    "AUTHORED", "CITES", "STUDIES", "USES_METHOD", "USES_DATASET", "AFFILIATED_WITH", "MAKES_CLAIM", "SUPPORTS",
    "CONTRADICTS", "BELONGS_TO", "RELATED_TO", "SIMILAR_TO", "PREDICTED_LINK", "MEASURED_BY",
]
OBSERVED = ["STUDIES", "USES_METHOD", "USES_DATASET", "CITES", "AUTHORED", "MAKES_CLAIM", "AFFILIATED_WITH"]
ASSOCIATIVE = ["STUDIES", "USES_METHOD", "USES_DATASET", "MEASURED_BY", "BELONGS_TO", "RELATED_TO"]
PREDICTED = "PREDICTED_LINK"
#: Papers from this year on are recent.
RECENT_YEAR = 2023

NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("name", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("props", T.MapType(T.StringType(), T.StringType()))])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("predicted", T.BooleanType()), T.StructField("provenance", T.StringType())])

_S, _A = T.StringType(), T.ArrayType(T.StringType())
PAPER = T.StructType([T.StructField(n, t) for n, t in (("arxiv_id", _S), ("title", _S), ("year", T.IntegerType()), ("url", _S), ("field", _S), ("topics", _A), ("methods", _A), ("datasets", _A), ("authors", _A), ("author_status", _S), ("summary", _S), ("summary_source", _S), ("corpus_tier", _S))])
CITATION = T.StructType([T.StructField(n, _S) for n in ("source", "target", "relation", "citation_source", "provenance", "note")])
CLAIM = T.StructType([T.StructField(n, t) for n, t in (("id", _S), ("text", _S), ("paper", _S), ("stance", _S), ("source", _S), ("confidence", _S), ("polarity", _S), ("direction", _S), ("assertive", T.BooleanType()), ("tension_with", _A))])
COUNTED = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("paper_count", T.IntegerType())])
CORPUS = T.StructType([T.StructField("title", _S), T.StructField("corpus_version", _S), T.StructField("papers", T.ArrayType(PAPER)), T.StructField("topics", T.ArrayType(COUNTED)), T.StructField("methods", T.ArrayType(COUNTED)), T.StructField("datasets", T.ArrayType(COUNTED)), T.StructField("citations", T.ArrayType(CITATION)), T.StructField("claims", T.ArrayType(CLAIM))])
