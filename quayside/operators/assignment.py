"""Scored one-to-one assignment of the lines of a consignment's documents: a grouped map over consignments.

Documents are taken in their order of precedence. The lines of each are assigned to the groups so far so that the sum
of scores is largest; pairs below the least similarity are then split, and lines without a group found one. Nothing
built in solves an assignment, so each consignment is solved in one Python call; a consignment is a bounded group.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.scalars import description_tokens
from quayside.schemas import DOC_TYPES

#: Weight of the description against the position, and the least similarity of two lines of the same goods.
DESCRIPTION_WEIGHT, LEAST_SIMILARITY = 0.85, 0.30
#: Share of the weighted tokens in the similarity of descriptions; the rest is the sequence ratio of the sorted tokens.
TOKEN_SHARE = 0.8
SCHEMA = "consignment_id string, group_no int, source_doc string, line_id long, score double"


class Consignment:
    """The lines of one consignment as a matrix of lines by tokens; ``rank`` is the place of each line's document."""

    def __init__(self, lines: pd.DataFrame) -> None:
        self.line_id, self.rank, self.place = (lines[c].to_numpy() for c in ("line_id", "rank", "place"))
        tokens = [list(t) for t in lines["tokens"]]
        known = {t: k for k, t in enumerate(sorted({t for row in tokens for t in row}))}
        self.holds = np.zeros((len(tokens), len(known)))
        for i, row in enumerate(tokens):
            self.holds[i, [known[t] for t in row]] = 1.0
        self.text = [" ".join(row) for row in tokens]

    def similarity(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Similarity of the lines ``old`` to the lines ``new``; the weights are those of both together."""
        both = self.holds[np.concatenate([old, new])]
        seen = both.sum(axis=0)
        weight = np.where(seen > 0, np.log1p(len(both) / np.maximum(seen, 1.0)), 0.0)
        shared = (self.holds[old] * weight) @ self.holds[new].T
        union = (self.holds[old] @ weight)[:, None] + (self.holds[new] @ weight)[None, :] - shared
        ratio = np.zeros_like(shared)
        for j, item in enumerate(new):
            matcher = SequenceMatcher(None, "", self.text[item])
            for i, member in enumerate(old):
                if self.text[item] and self.text[member]:
                    matcher.set_seq1(self.text[member])
                    ratio[i, j] = 1.0 if self.text[member] == self.text[item] else matcher.ratio()
        return TOKEN_SHARE * np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) + (1 - TOKEN_SHARE) * ratio


def largest_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the one-to-one assignment with the largest sum, by shortest augmenting paths.

    Every row is assigned if there are no more rows than columns, else every column; among equals the lowest column.
    """
    if score.size == 0:
        return []
    if score.shape[0] > score.shape[1]:
        return sorted((r, c) for c, r in largest_assignment(score.T))
    cost = -score
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    row_of = np.full(cols, -1)
    for start in range(rows):
        reached, came_from = np.full(cols, np.inf), np.full(cols, -1)
        done = np.zeros(cols, dtype=bool)
        row, gone, end = start, 0.0, -1
        while end < 0:
            step = gone + cost[row] - row_price[row] - col_price
            better = ~done & (step < reached - 1e-12)
            reached[better], came_from[better] = step[better], row
            col = int(np.argmin(np.where(done, np.inf, reached)))
            gone, done[col] = reached[col], True
            if row_of[col] < 0:
                end = col
            else:
                row = row_of[col]
        # prices move so that every edge on the tree stays tight
        row_price[start] += gone
        for col in np.flatnonzero(done):
            if row_of[col] >= 0:
                row_price[row_of[col]] += gone - reached[col]
            col_price[col] -= gone - reached[col]
        while end >= 0:
            row = came_from[end]
            before = np.flatnonzero(row_of == row)
            row_of[end] = row
            if row == start:
                break
            end = int(before[before != end][0])
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def match_consignment(lines: pd.DataFrame) -> pd.DataFrame:
    """The groups of one consignment's prepared lines, numbered in the order of the first document, then of the others.

    ``group_of`` holds the group of each line, -1 for the lines of documents to come; a group's place is its first line's.
    """
    lines = lines.sort_values(["rank", "place", "line_id"])
    c = Consignment(lines)
    group_of, scores, places = np.full(len(lines), -1), np.ones(len(lines)), []
    for rank in sorted(set(c.rank)):
        old, new = np.flatnonzero(c.rank < rank), np.flatnonzero(c.rank == rank)
        if len(old):
            alike = np.zeros((len(places), len(new)))
            np.maximum.at(alike, group_of[old], c.similarity(old, new))
            score = DESCRIPTION_WEIGHT * alike + (1 - DESCRIPTION_WEIGHT) * (1 - np.abs(np.array(places)[:, None] - c.place[new]))
            for g, i in largest_assignment(score):
                if alike[g, i] >= LEAST_SIMILARITY:
                    group_of[new[i]], scores[new[i]] = g, round(float(score[g, i]), 3)
        for i in new[group_of[new] < 0]:
            group_of[i] = len(places)
            places.append(c.place[i])
    found = pd.DataFrame({"consignment_id": lines["consignment_id"], "group_no": group_of + 1, "source_doc": lines["source_doc"], "line_id": c.line_id, "score": scores})
    return found.sort_values(["group_no", "line_id"])


def prepare_lines(lines: DataFrame, partitions: int = 8) -> DataFrame:
    """Tokens, rank of the document and place within it (0 to 1) of every line; a null consignment is a line's own."""
    own = F.coalesce(F.col("consignment_id"), F.concat(F.lit("\u0001"), F.col("line_id").cast("string")))
    rank = F.array_position(F.array(*[F.lit(d) for d in DOC_TYPES]), F.col("source_doc"))
    place = F.percent_rank().over(W.partitionBy("key", "source_doc").orderBy(F.asc_nulls_last("line_no"), "line_id"))
    keyed = lines.select(own.alias("key"), "consignment_id", "source_doc", "line_no", "line_id", description_tokens(F.col("description")).alias("tokens"), rank.cast("int").alias("rank")).where("rank > 0")
    return keyed.repartition(partitions, "key").withColumn("place", place).drop("line_no")


def assign_lines(lines: DataFrame) -> DataFrame:
    """(consignment_id, group_no, source_doc, line_id, score): each line in exactly one group of its consignment.

    The score is the combined one of description and place, 1 for the line that founds its group. Lines of unknown
    documents are left out; a line without a consignment is alone.
    """
    spark = lines.sparkSession
    # the rows are few bytes but much work: a stated number of partitions is not coalesced by size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return prepare_lines(lines, parts).groupBy("key").applyInPandas(match_consignment, SCHEMA)
