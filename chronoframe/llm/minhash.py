"""MinHash near-duplicates: fast similarity sketches, banding, and exact verification on whole sets.

A sketch is filled in rounds of hashed bin placement (:func:`copies.fast_sketches`): it costs about one
hash for each shingle, every coordinate is filled whatever the size of the set, and the share of equal
coordinates is concentrated about the Jaccard similarity. Bands of coordinates are the keys by which
sets meet; the sketch itself discards pairs far below the limit, and whole sets confirm the rest.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import COPY_BLOCK, agree, named_rows, packed, set_classes

#: Words of a shingle, and the least Jaccard similarity that links two texts.
SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates of a sketch, and how many make a band. Two sets at a similarity of 0.8 share none of the 38 bands with a
#: chance of 3e-7; unrelated texts at 0.01 share one with a chance of 4e-9.
COORDS, BAND = 192, 5
#: Deviations of the number of equal coordinates beyond which a pair is discarded.
DISCARD_SIGMAS = 6.0


def _packed_parts(shingles: np.ndarray, ends: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    return packed(sketches)


def least_equal(similarity: float, coords: int = COORDS) -> int:
    """Equal coordinates that sets of at least this similarity have, but for a chance of 1e-9."""
    return int(coords * similarity - DISCARD_SIGMAS * np.sqrt(coords * similarity * (1 - similarity)))


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, coords: int = COORDS, band: int = BAND, block: int = COPY_BLOCK
) -> DataFrame:
    """``(id_col, n_shingles, component, kept)``: one row per row of ``docs``.

    A text's set holds the distinct shingles of its words (A-Z lower-cased, between ASCII white space), or its
    whole sequence of fewer words; n_shingles is its size. Sets of at least the Jaccard ``similarity`` link;
    component is the smallest id that is reached, kept whether that is the row's own. Null, empty and wordless
    texts have the empty set, which links with nothing: such a row is its own component. Repeated rows and rows
    of one id each get their row; two texts under one id are told apart. A null id never names a component: rows
    that link with no id have a null component, and rows with a null id are kept only in that case. An empty table
    gives an empty result, other columns are not read.
    """
    own, texts = set_classes(docs, id_col, text_col, shingle, coords, band, _packed_parts, partial(agree, least_equal(similarity, coords)), similarity, block)
    named = named_rows(own, texts, id_col)
    component = F.when(F.col("size") == 0, F.col(id_col)).otherwise(F.col("component"))
    return named.select(F.col(id_col), F.col("size").alias("n_shingles"), component.alias("component"), F.col(id_col).eqNullSafe(component).alias("kept"))
