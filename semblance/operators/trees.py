"""Structure as a tree: what is nested in what, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions import code as C
from semblance.functions.arrays import let
from semblance.functions.text import strip_comments
from semblance.functions.trees import gram_batches
from semblance.operators.pairs import bag_scores, item_counts
from semblance.session import cut_lineage

# Code tokens with the indentation kept at the line feed before it.
TREE_PATTERN = C.CODE_TOKEN_PATTERN.replace(r"|\n|", r"|\n[ \t]*|")


def tree_items(text: Column, preserve_names: bool = False) -> Column:
    """Shapes of the code tokens of a text; line feeds stay, with the blanks after them."""

    def shapes(toks: Column) -> Column:
        return F.transform(toks, lambda x: F.when(F.startswith(x["t"], F.lit("\n")), x["t"]).otherwise(
            C.shape(x["t"], x["b"], x["a"], preserve_names)
        ))

    toks = F.regexp_extract_all(F.concat(F.lit("\n"), strip_comments(text)), F.lit(TREE_PATTERN), F.lit(0))
    return let(let(toks, C.with_neighbours), shapes)


def tree_grams(submissions: DataFrame, text: str = "raw_text", preserve_names: bool = False) -> DataFrame:
    """``(corpus_id, name, grams)``: the pq-grams of the tree of each text."""
    items = submissions.select("corpus_id", "name", tree_items(F.col(text), preserve_names).alias("items"))
    schema = submissions.select("corpus_id", "name").schema.add("grams", T.ArrayType(T.StringType()))
    return items.mapInArrow(gram_batches(["corpus_id", "name"]), schema)


def tree_scores(submissions: DataFrame, targets: DataFrame, text: str = "raw_text", preserve_names: bool = False) -> DataFrame:
    """``tree``, the Dice coefficient of the pq-grams of each pair.

    It is 1 for texts of one structure; a block that is moved or nested otherwise changes the
    grams around it. Texts without code tokens score 0.
    """
    rows = cut_lineage(tree_grams(submissions, text, preserve_names))
    return bag_scores(rows, lambda r: item_counts(r, F.col("grams")), targets, "tree", 0.0)
