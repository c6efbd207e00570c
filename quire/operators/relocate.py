"""What became of paths between two editions of a work, and resolving old paths.

Divisions of an edition: path, parent, head, position, chain (headings from the top), occurrence (of the chain), digest."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.shared import written

SIMILAR = 0.5
NEAR = 0.01
HOPS = 10


def editions(rows: DataFrame) -> DataFrame:
    """Adds position (from 0 among siblings) and occurrence (of its chain in the file) to rows (file, path, parent, nth, id, place, chain, ...)."""
    siblings = Window.partitionBy("file", "parent").orderBy("nth", "id")
    same = Window.partitionBy("file", "chain").orderBy("place")
    return rows.withColumn("position", F.row_number().over(siblings) - 1).withColumn("occurrence", F.row_number().over(same))


def unique_by(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key no other has. A join of a count, so no group is gathered."""
    once = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").select(*key)
    return rows.join(once, [*key])


def by_text(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """old, new: where divisions are now whose digest is unique on both sides (by: in their file, say), whether or not the path changed."""
    old = unique_by(before.where("digest is not null"), *by, "digest").select(*by, "digest", F.col("path").alias("old"))
    new = unique_by(after.where("digest is not null"), *by, "digest").select(*by, "digest", F.col("path").alias("new"))
    return old.join(new, [*by, "digest"]).select("old", "new")


def by_digest(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Those of by_text() whose path changed."""
    return by_text(before, after, by).where("old != new")


def by_chain(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """old, new: divisions with the same headings from the top and the same occurrence of them."""
    new = after.select(*by, "chain", "occurrence", F.col("path").alias("new"))
    return before.select(*by, "chain", "occurrence", F.col("path").alias("old")).join(new, [*by, "chain", "occurrence"]).where("old != new").select("old", "new")


def similarity(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 1.0 if x <= y or y <= x else len(x & y) / len(x | y)


def alike(heads: list[frozenset[str]], others: list[frozenset[str]], least: float) -> list[list[tuple[float, int]]]:
    """Of each of heads (sets of words), similarity and number of those of others with `least` or more.

    Others are looked up by rare words alone. One that holds a head, or is held by it, has that one's rarest word; two heads that share
    at least so many words share one of the rarest few of each."""
    df: dict[str, int] = {}
    for h in heads + others:
        for w in h:
            df[w] = df.get(w, 0) + 1
    rare = lambda h: sorted(h, key=lambda w: (df[w], w))

    def prefix(h: frozenset[str]) -> int:
        sizes = range(max(2, math.ceil(least * len(h))), math.floor(len(h) / least) + 1)
        shared = min((math.ceil(least / (1 + least) * (len(h) + s) - 1e-9) for s in sizes), default=len(h))
        return max(1, len(h) - shared + 1)

    by_word, by_rarest, by_prefix = ({}, {}, {})
    for i, h in enumerate(others):
        own = rare(h)
        for table, words in ((by_word, own), (by_rarest, own[:1]), (by_prefix, own[: prefix(h)])):
            for w in words:
                table.setdefault(w, []).append(i)
    out = []
    for h in heads:
        own = rare(h)
        found = set(by_word.get(own[0], ())) if own else set()
        for w in own:
            found.update(by_rarest.get(w, ()))
        for w in own[: prefix(h)]:
            found.update(by_prefix.get(w, ()))
        scored = ((1.0 if h <= others[i] or others[i] <= h else len(h & others[i]) / len(h | others[i]), i) for i in found)
        out.append([(s, i) for s, i in scored if s >= least])
    return out


def greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one parent's rows (side, path, head, position): each old one in order takes the most similar new one that is left.

    Equal headings are looked up once, and each remembers how far its candidates are taken, so that time grows with the rows, not with their
    pairs. A parent is part of one file."""
    rows = frame.sort_values(["position", "path"])
    olds, news = rows[rows.side == 0], rows[rows.side == 1]
    words = lambda part: [frozenset(_normal(h).split()) for h in part["head"]]
    old_words, new_words = words(olds), words(news)
    old_sets, new_sets = list(dict.fromkeys(old_words)), list(dict.fromkeys(new_words))
    members: dict[frozenset[str], list[int]] = {}
    for i, h in enumerate(new_words):
        members.setdefault(h, []).append(i)
    places, paths = news["position"].tolist(), news["path"].tolist()
    levels, at_place = {}, {}
    for h, found in zip(old_sets, alike(old_sets, new_sets, SIMILAR - NEAR), strict=True):
        by_score: dict[float, list[int]] = {}
        for score, j in found:
            if h and new_sets[j]:
                by_score.setdefault(score, []).extend(members[new_sets[j]])
        levels[h] = [[score, sorted(own), 0] for score, own in sorted(by_score.items(), reverse=True)]
        at_place[h] = {}
        for score, own, _ in levels[h]:
            for i in own:
                at_place[h].setdefault(places[i], []).append((score, i))
    out, taken = [], [False] * len(paths)
    for path, h, position in zip(olds["path"], old_words, olds["position"], strict=True):
        # (score, the earlier the better): those in the same place, and of each similarity the first that is left
        own = [(score + NEAR, -i) for score, i in at_place[h].get(position, ()) if not taken[i] and score + NEAR >= SIMILAR]
        for level in levels[h]:
            score, listed, at = level
            if score < SIMILAR:
                break
            while at < len(listed) and taken[listed[at]]:
                at += 1
            level[2] = at
            if at < len(listed):
                own.append((score, -listed[at]))
                break
        if own:
            best = -max(own)[1]
            taken[best] = True
            out.append((path, paths[best]))
    return pd.DataFrame(out, columns=["old", "new"])


def _normal(head: str | None) -> str:
    return " ".join(re.sub(r"[!-/:-@\[-`{-~\s]+", " ", (head or "").lower()).split())


def match(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """old, new, reason for paths of before that are gone: by digest, then headings, then a similar sibling, then the nearest
    ancestor that is left or moved (PARENT). by: columns within which divisions are matched (their file, where several are
    imported at once).

    Live paths are never redirected. A path is taken if its old division stays there or if a division is known by its text to
    be there now, and each is taken once; one whose old division moved away is free. Siblings are those under the same parent,
    or under what the parent has become: parents are matched before their children, a level a round."""
    live = after.select(F.col("path").alias("new")).distinct()
    gone = written(before.join(live, before["path"] == live["new"], "left_anti"), "gone")
    without = lambda rows, taken, c: rows.join(taken.select(F.col(c).alias("path")), "path", "left_anti")
    # a tier's pairs are written, so that the next ones don't compute them again
    known = written(by_text(before, after, by), "tier")
    first = known.join(gone.select(F.col("path").alias("old")), "old", "left_semi")
    elsewhere = known.where("old != new").select(F.col("old").alias("path"))
    stay = before.join(live, before["path"] == live["new"], "left_semi").join(elsewhere, "path", "left_anti")
    rest, free = without(gone, first, "old"), without(without(after, known, "new"), stay, "path")
    second = by_chain(rest, free, by)
    second = written(second.withColumn("_n", F.row_number().over(Window.partitionBy("new").orderBy("old"))).where("_n = 1").drop("_n"), "tier")
    moved = first.unionByName(second)
    columns = ["parent", "side", "path", "head", "position"]
    rest, free = written(without(rest, second, "old").select("parent", "path", "head", "position"), "rest"), without(free, second, "new")
    fresh, third = moved, None
    alive = live.select(F.col("new").alias("parent"))
    asked = rest.join(alive, "parent", "left_semi")
    while True:
        through = rest.join(alive, "parent", "left_anti").join(fresh.select(F.col("old").alias("parent"), F.col("new").alias("_up")), "parent").withColumn("parent", F.col("_up")).drop("_up")
        both = asked.unionByName(through).withColumn("side", F.lit(0)).select(*columns).unionAll(free.withColumn("side", F.lit(1)).select(*columns))
        fresh = written(both.groupBy("parent").applyInPandas(greedy, "old string, new string"), "tier")
        if fresh.isEmpty():
            break
        third = fresh if third is None else third.unionByName(fresh)
        rest, free = without(rest, fresh, "old"), without(free, fresh, "new")
        asked = asked.limit(0)
    moved = moved if third is None else moved.unionByName(third)
    to = live.select(F.col("new").alias("p"), F.col("new").alias("to")).unionAll(moved.select("old", "new"))
    up = nearest(rest.select(F.col("path").alias("old")), "old", to.select(F.col("p").alias("path"))).where("ancestor is not null")
    parents = up.join(to, up["ancestor"] == to["p"]).select("old", F.col("to").alias("new"), F.lit("PARENT").alias("reason"))
    return moved.select("old", "new", F.lit("MOVED").alias("reason")).unionAll(parents)


def displaced(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """old, new: divisions that went elsewhere while another one took their path. It is live and redirects nowhere, but what was saved for the old division follows it."""
    return by_digest(before, after, by).join(after.select(F.col("path").alias("old")).distinct(), "old", "left_semi")


def followed(moves: DataFrame, away: DataFrame) -> DataFrame:
    """old, new: where each old division really went: moves, with displaced ones over them."""
    return moves.select("old", "new").join(away.select("old"), "old", "left_anti").unionByName(away.select("old", "new"))


def nearest(rows: DataFrame, path: str, live: DataFrame) -> DataFrame:
    """Adds ancestor: the longest proper prefix of the path (author and work at least) among live paths, by equi-joins on all prefixes."""
    own = rows.select(path).distinct().select(path, F.explode(F.filter(T.prefixes(F.col(path)), lambda p, i: i > 0)).alias("p"))
    hit = own.join(live.select(T.canonical_path(F.col("path")).alias("p")).distinct(), "p", "left_semi")
    best = hit.groupBy(path).agg(F.max_by("p", F.length("p")).alias("ancestor"))
    return rows.join(best, path, "left")


def resolved(relocations: DataFrame, wanted: DataFrame, hops: int = HOPS) -> DataFrame:
    """path, target: where each of wanted (path) lives now, canonical: the end of its chain, or where it stands after so many
    hops. Null if it hasn't moved, comes home or goes round in a loop. One join a hop; a chain that has ended is spread by
    its own path rather than joined by null."""
    # of a path and the same without its leading slash the first counts
    step = relocations.select(F.startswith("old", F.lit("/")).alias("first"), T.canonical_path(F.col("old")).alias("key"), T.canonical_path(F.col("new")).alias("next")).groupBy("key").agg(F.max_by("next", F.struct("first", "next")).alias("next"))
    start = T.canonical_path(F.col("path"))
    rows = wanted.select("path").distinct().select("path", start.alias("start"), start.alias("at"), F.array(start).alias("seen"), F.lit(True).alias("open"))
    for hop in range(hops):
        rows = rows.withColumn("key", F.when(F.col("open"), F.col("at")).otherwise(F.concat(F.lit("\0"), "path"))).join(step, "key", "left")
        loop = F.array_contains("seen", F.col("next")) if hop < hops - 1 else F.lit(False)
        rows = rows.select("path", "start", F.when(F.col("open") & loop, F.lit(None)).otherwise(F.coalesce("next", "at")).alias("at"), F.when(F.col("next").isNotNull(), F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"), (F.col("open") & F.col("next").isNotNull() & ~F.coalesce(loop, F.lit(False))).alias("open"))
    return wanted.join(rows.select("path", F.when(F.col("at") != F.col("start"), F.col("at")).alias("target")), "path", "left")


def repointed(relocations: DataFrame, moves: DataFrame, live: DataFrame, follow: DataFrame | None = None) -> DataFrame:
    """Earlier relocations with their targets moved on at once (swaps don't chain; follow: all that moved, if that is more than moves),
    without those whose old path lives again or that came home; and moves, which replace earlier ones of their old path."""
    kept = relocations.join(live.select(F.col("path").alias("old")), "old", "left_anti").join(moves.select("old"), "old", "left_anti")
    step = (moves if follow is None else follow).select(F.col("old").alias("new"), F.col("new").alias("_to"))
    on = kept.join(step, "new", "left").select("old", F.coalesce("_to", "new").alias("new"), "reason")
    return on.where("old != new").unionByName(moves.select("old", "new", "reason"))


def rewritten(references: DataFrame, moves: DataFrame, column: str = "path") -> DataFrame:
    """References with moved paths replaced, all in one step."""
    step = moves.select(F.col("old").alias(column), F.col("new").alias("_to"))
    return references.join(step, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def heading_similarity(a: Column, b: Column) -> Column:
    split = lambda c: F.filter(F.split(T.heading_normal(c), " "), lambda w: w != "")
    return T.jaccard(split(a), split(b))
