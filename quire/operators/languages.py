"""Language of texts by a model of letter sequences, trained on texts of known language.

The model is, of each language, how frequent its most frequent sequences of one to three letters are (naive Bayes, with a count of a half for
those never seen). The WORDS words of most texts count as a whole, by their share of each language's texts: what all languages have, such as a notice
of a license, tells nothing, and neither do what has digits and a word said again at once. Training counts them in Spark over the whole of all texts; the model, languages times KEPT + WORDS rows at most, goes with the tasks. As for a file: only what follows the header counts, tags are
spaces, and fewer than LEAST of the first SAMPLE characters are no language (the hint of a path decides there).

A text's language is its own one, in which passages of others may be quoted, even longer ones: of each language, the likelihood of the
whole text is taken with the best choice of passages. One begins with a letter that isn't small or after the end of a sentence, goes on to the end of a
sentence, and is followed by the text's own words or another passage, unless it has a line to itself; it costs QUOTED, LONGER a word more, and OPEN if nothing follows.
Null texts, texts without a letter, and ties have none; rows without text or language teach nothing."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.language import LEAST, SAMPLE

KEPT = 3000
LONGEST = 3
WORDS = 20000
UNSEEN = 0.5
QUOTED = 15.0
LONGER = 0.02
OPEN = 12.0
#: A word's sequences overlap: together they say this much less than if each stood alone.
OVERLAP = 1.5
#: What one word says at most; a word that no language has TELLING times as often as another says nothing.
MOST = 7.0
TELLING = 10
#: Weights of words that a task remembers.
REMEMBERED = 200_000
MODEL = "lang string, gram string, n long, total long"


def body(raw: Column) -> Column:
    """What detection looks at: after the header, without tags."""
    return F.regexp_replace(F.substring_index(F.coalesce(raw, F.lit("")), "</teiHeader>", -1), "<[^>]+>", " ")


def trained(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """MODEL of texts with their language: sequences, and words (with "=" before) by the texts that have them."""
    rows = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("raw"))
    found = rows.select("lang", F.regexp_extract_all(F.lower(body(F.col("raw"))), F.lit(r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"), F.lit(0)).alias("ws"))
    words = found.select("lang", F.explode("ws").alias("w")).groupBy("lang", "w").count()
    own = F.concat(F.lit(" "), "w", F.lit(" "))
    length = F.length("w") + 2
    starts = lambda n: F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.concat(*(F.transform(starts(n), lambda i, n=n: own.substr(i, F.lit(n))) for n in range(1, LONGEST + 1)))
    counts = words.select("lang", F.explode(grams).alias("gram"), "count").where("gram != ' '").groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= KEPT).drop("r")
    grams = kept.withColumn("total", F.sum("n").over(Window.partitionBy("lang"))).select("lang", "gram", "n", "total")
    by_text = found.select("lang", F.explode(F.array_distinct("ws")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    most = by_text.groupBy("w").agg(F.sum("n").alias("_n")).where("_n >= 8").orderBy(F.desc("_n"), "w").limit(WORDS).select("w")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("total"))
    whole = by_text.join(most, "w").join(F.broadcast(sizes), "lang")  # a row a language
    return grams.unionAll(whole.select("lang", F.concat(F.lit("="), "w"), "n", "total"))


class Detector:
    """A model in memory."""

    def __init__(self, model: DataFrame):
        rows = model.collect()  # languages times KEPT + WORDS at most
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = self._weights([r for r in rows if not r["gram"].startswith("=")])
        self.words = self._weights([r for r in rows if r["gram"].startswith("=")])
        self._known: dict[str, tuple[float, ...] | None] = {}

    def _weights(self, rows: list) -> dict[str, list[float]]:
        at = {c: i for i, c in enumerate(self.langs)}
        keys = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
        totals = np.ones(len(self.langs))
        n = np.full((len(keys), len(self.langs)), UNSEEN)
        for r in rows:
            n[keys[r["gram"]], at[r["lang"]]] += r["n"]
            totals[at[r["lang"]]] = r["total"]
        spread = totals + (1 if rows and rows[0]["gram"].startswith("=") else UNSEEN * len(keys))
        return dict(zip(keys, np.log(n / spread).tolist(), strict=True))

    def weight(self, word: str) -> tuple[float, ...] | None:
        """By language, how much less likely the word is than in the likeliest; None if nothing of it is known."""
        if word not in self._known:
            found = self.words.get(f"={word}")
            if found is not None and max(found) - min(found) < np.log(TELLING):
                found = [0.0] * len(self.langs)
            if found is None:
                own = f" {word} "
                parts = [self.grams[g] for n in range(1, LONGEST + 1) for i in range(len(own) - n + 1) if (g := own[i : i + n]) in self.grams]
                found = [sum(c) / OVERLAP for c in zip(*parts, strict=True)] if parts else None
            top = max(found) if found else 0.0
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = None if found is None else tuple(max(x - top, -MOST) for x in found)
        return self._known[word]

    def blocks(self, text: str) -> list[list]:
        """[weights by language, words, whether a sentence ended before it, whether a line began with it] of what lies between the places where a passage may begin or end."""
        out: list[list] = []
        known, stop, line, before = self._known, True, True, ""
        for word in re.findall(r"[^\W_]+|[.!?\n]", text):
            if word in ".!?\n":
                stop, line = True, line or word == "\n"
                continue
            low = word.lower()
            own = None
            if low != before and word.isalpha():
                own = known[low] if low in known else self.weight(low)
            before = low
            if own is None:
                continue
            if stop or not word[0].islower():
                out.append([[own], 1, stop, line])
                stop = line = False
            else:
                out[-1][0].append(own)
        for block in out:
            block[1] = len(block[0])
            block[0] = [sum(c) for c in zip(*block[0], strict=True)]
        return out

    def likelihood(self, blocks: list[list], own: int) -> float:
        """Of the whole text, if it is in this language."""
        others = [i for i in range(len(self.langs)) if i != own]
        never = -np.inf
        at, inside, lines = 0.0, [never] * len(others), [never] * len(others)  # in its own words; in a passage that began within a line, or with one
        for weights, words, stop, line in blocks:
            if stop:
                at = max(at, *inside, *lines)
            begun, more = at - QUOTED, LONGER * words
            at += weights[own]
            if line:
                lines = [max(x, begun) + weights[i] - more for x, i in zip(lines, others, strict=True)]
                inside = [x + weights[i] - more for x, i in zip(inside, others, strict=True)]
            else:
                inside = [max(x, begun) + weights[i] - more for x, i in zip(inside, others, strict=True)]
                lines = [x + weights[i] - more for x, i in zip(lines, others, strict=True)]
        return max(at, *lines, *(x - OPEN for x in inside))

    def of(self, text: str) -> str | None:
        if len(text[:SAMPLE].strip()) < LEAST:
            return None
        blocks = self.blocks(text)
        if not blocks:
            return None
        # By each language, what is lost against the best of every block. With passages, no less than this or QUOTED is lost.
        lost = sorted((sum(max(w) - w[i] for w, *_ in blocks), i) for i in range(len(self.langs)))
        if lost[0][0] < QUOTED and (len(lost) == 1 or lost[0][0] < lost[1][0]):
            return self.langs[lost[0][1]]
        score = [self.likelihood(blocks, i) for i in range(len(self.langs))]
        best = max(score)
        return self.langs[score.index(best)] if score.count(best) == 1 else None

    def detected(self, raw: Column) -> Column:
        """The language of each text, or null."""

        @F.pandas_udf("string")
        def own(texts: pd.Series) -> pd.Series:
            return texts.map(self.of).astype(object)

        return own(body(raw))
