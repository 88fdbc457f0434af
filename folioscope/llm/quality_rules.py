"""Quality rules by distribution divergence, with DataFrame functions only.

References are learnt from all rows with a language: for each language the shares of character classes and
of its commonest short words. A document long enough is rejected if its character classes, or its common
words, lie further than a limit (Jensen-Shannon distance, base 2) from the nearest language's reference. The
limit for words is each language's own: a share of the distance that a text with none of its common words has.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import checkpointed

#: White space and symbols as the base counts define them.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
CLASSES = ("lower", "upper", "digit", "symbol", "other")
#: Words of a language's histogram; only words of so many letters at most can be among them, which bounds the count.
COMMON_WORDS, WORD_LETTERS = 16, 4
#: Languages with at least this share of all words have a reference, so there are no more than 1 / LEAST_SHARE. Rows of rarer ones are
#: judged by the nearest reference, as all rows are.
LEAST_SHARE = 0.001
#: So many references' distances are spelt out in the plan, which is compiled; of more, the same distances are taken over an array.
SPELT_OUT = 16
#: Shorter documents are not compared: their histograms say little.
LEAST_CHARS, LEAST_WORDS = 120, 50
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.75
#: A language's word limit is WORD_SHARE of the distance of a text with none of its common words, WORD_LIMIT at most.
#: If more than MOST_LACKING of a language's own documents hold no common word at all, lacking them says nothing there.
WORD_SHARE, MOST_LACKING = 0.9, 0.1
POSITION_BITS = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def rest_of(joined: Column) -> Column:
    """Without the letters a to z, which are most of most texts, so that the classes are sought in what is left."""
    return F.regexp_replace(joined, "[a-z]+", "")


def class_counts(joined: Column, rest: Column) -> list[Column]:
    """Characters of each of CLASSES but the last in a text without white space; rest is rest_of(joined)."""
    lower = F.length(joined) - F.length(rest) + without(rest, r"[^\p{Ll}]+")
    return [lower, without(rest, r"[^\p{Lu}]+"), without(rest, "[^0-9]+"), F.length(rest) - without(rest, SYMBOLS)]


@dataclass
class References:
    """Of each language: shares of CLASSES; common words and their shares, the last share for all other words."""

    classes: list[list[float]] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    lacking: list[float] = field(default_factory=list)  # share of its documents that hold none of the words

    def telling(self, i: int) -> bool:
        """Whether texts of the language i can be expected to hold some of its common words."""
        return bool(self.words[i]) and self.lacking[i] <= MOST_LACKING

    def limit(self, i: int) -> float:
        return min(WORD_LIMIT, WORD_SHARE * distance_without(self.shares[i]))


def distance_without(shares: list[float]) -> float:
    """js_distance of a text with none of the common words: all its words are in the last share."""
    m = (1 + shares[-1]) / 2
    return math.sqrt(max(0.0, (sum(shares[:-1]) - math.log2(m) + (shares[-1] * math.log2(shares[-1] / m) if shares[-1] > 0 else 0.0)) / 2))


def learn(docs: DataFrame, lang: str = "lang") -> References:
    """From every row with a language and a text; of each language of LEAST_SHARE or more COMMON_WORDS words and a few sums come to the driver."""
    base = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")
    short = F.when(F.length("w") <= WORD_LETTERS, F.col("w"))  # all longer words are counted together
    counts = base.select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", short.alias("w")).agg(F.count("*").alias("n"))
    letters = F.when(F.col("w").rlike(rf"^\p{{L}}{{1,{WORD_LETTERS}}}$"), F.lower("w"))
    counts = checkpointed(counts.groupBy("lang", letters.alias("w")).agg(F.sum("n").alias("n")))
    all_words = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SHARE * all_words).orderBy(F.desc("n"), "lang").collect()
    out = References()
    if not top:
        return out
    names = [r.lang for r in top]
    order = W.partitionBy("lang").orderBy(F.desc("n"), "w")
    common = counts.where(F.col("w").isNotNull() & F.col("lang").isin(names)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= COMMON_WORDS).collect()
    own = {x: sorted((r for r in common if r.lang == x), key=lambda r: r.k) for x in names}
    # a text without any of its language's words; no word, no such text with one
    pattern = lambda ws: rf"(?iu)(?:\A|{SPACE})(?:{'|'.join(r.w for r in ws)})(?:{SPACE}|\z)" if ws else "(?!)"
    patterns = docs.sparkSession.createDataFrame([(x, pattern(own[x])) for x in names], "lang string, pattern string")
    j = base.join(F.broadcast(patterns), "lang").select("lang", "text", "pattern", F.regexp_replace("text", SPACE, "").alias("j")).withColumn("rest", rest_of(F.col("j")))
    long = (F.length("j") >= LEAST_CHARS) & (F.length("text") - F.length("j") >= LEAST_WORDS)
    c = j.select("lang", F.length("j").alias("all"), *[x.alias(k) for x, k in zip(class_counts(F.col("j"), F.col("rest")), CLASSES)], long.alias("long"), (long & ~F.rlike("text", "pattern")).alias("none"))
    sums = {r.lang: r for r in c.groupBy("lang").agg(F.sum("all").alias("all"), *[F.sum(k).alias(k) for k in CLASSES[:-1]], F.count_if("long").alias("long"), F.count_if("none").alias("none")).collect()}
    for r in top:
        out.langs.append(r.lang)
        n = sums[r.lang]
        out.classes.append([n[k] / n["all"] for k in CLASSES[:-1]] + [1 - sum(n[k] for k in CLASSES[:-1]) / n["all"]])
        shares = [x.n / r.n for x in own[r.lang]]
        out.words.append([x.w for x in own[r.lang]])
        out.shares.append([*shares, 1 - sum(shares)])
        out.lacking.append(n["none"] / max(1, n["long"]))
    return out


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of an array of shares and fixed shares.

    The terms are spelt out for each share, as x log x sums, so that they are compiled.
    """
    xlogx = lambda x: F.coalesce(x * F.log2(x), F.lit(0.0))  # noqa: E731  log2(0) is null
    terms = [xlogx(F.get(p, F.lit(i))) - 2 * xlogx((F.get(p, F.lit(i)) + F.lit(float(x))) / 2) for i, x in enumerate(q)]
    own = sum(x * math.log2(x) for x in q if x > 0)
    return F.sqrt(F.greatest(F.lit(0.0), (total(F.array(*terms)) + F.lit(own)) / 2))


def js_between(p: Column, q: Column) -> Column:
    """js_distance of two arrays of shares; null where either is null."""
    xlogx = lambda x: F.coalesce(x * F.log2(x), F.lit(0.0))
    found = F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda x, y: xlogx(x) + xlogx(y) - 2 * xlogx((x + y) / 2))) / 2))
    return F.when(p.isNotNull() & q.isNotNull(), found)


def covered(places: Column) -> Column:
    """Words that windows of three at these ascending places cover together."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    step = lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"))
    return F.aggregate(places, start, step, lambda s: s["sum"])


class Windows:
    """Windows of three words of an array column, to find those that come twice.

    If all hashes differ, none does. Else they are sorted by 44 bits of their hash, with their place in the rest of
    the same number; neighbours with one hash are then compared word by word. If any two differ, or the places need
    more bits, the words themselves are sorted instead, so the result is exact for every text.
    """

    def __init__(self, w: Column):
        self.w = w
        self.starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def at(self, i: Column) -> Column:
        return F.get(self.w, i)

    @staticmethod
    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    @staticmethod
    def key(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def hashes(self) -> Column:
        return F.transform(self.starts, lambda x, i: F.xxhash64(x, self.at(i + 1), self.at(i + 2)))

    @staticmethod
    def packed(hashes: Column) -> Column:
        """Sorted; null where all hashes differ."""
        put = F.transform(hashes, lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(put))

    def twins(self, hashed: Column) -> Column:
        near = lambda x, y: F.coalesce(self.key(x) == self.key(y), F.lit(False))
        return F.filter(hashed, lambda x, i: near(x, F.get(hashed, i + 1)) | ((i > 0) & near(x, F.get(hashed, i - 1))))

    def collide(self, twins: Column) -> Column:
        def differ(x: Column, y: Column) -> Column:
            a, b = self.place(x), self.place(y)
            return (self.key(x) == self.key(y)) & ((self.at(a) != self.at(b)) | (self.at(a + 1) != self.at(b + 1)) | (self.at(a + 2) != self.at(b + 2)))

        pairs = F.transform(twins, lambda x, i: F.struct(x.alias("x"), F.get(twins, i + 1).alias("y")))
        return F.coalesce(F.exists(pairs, lambda p: differ(p["x"], p["y"])), F.lit(False))

    def covered_exactly(self) -> Column:
        s = F.sort_array(F.transform(self.starts, lambda x, i: F.struct(x.alias("a"), self.at(i + 1).alias("b"), self.at(i + 2).alias("c"), i.alias("p"))))
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        twins = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | ((i > 0) & same(x, F.get(s, i - 1))))
        return covered(F.sort_array(F.transform(twins, lambda x: x["p"])))

    def repeated_words(self, twins: Column) -> Column:
        n = F.size(self.w)
        fast = covered(F.sort_array(F.transform(twins, self.place)))
        return F.when((n < 3) | twins.isNull(), 0).when((n < 1 << POSITION_BITS) & ~self.collide(twins), fast).otherwise(self.covered_exactly()).cast("long")


def measure(docs: DataFrame, refs: References, rules: str = "rules", lang: str = "lang") -> DataFrame:
    """docs with one more column, the struct `rules`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, kept.

    A null text has no words. Distances are null where a text is too short to be compared, or without
    references; such a text is kept if the base rules keep it. Word distances are scaled for each language so that
    WORD_LIMIT is its limit. They are null, too, for a row of a language whose texts need not hold its common words
    (without a language: if there is any such one). The nearest of all references counts, however many there are. Each row is judged
    by itself, so repeated rows, ties and empty tables need no care; texts are read whole; other columns are kept as they are.
    No shuffle.
    """
    own = "_q"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    c = lambda name: F.col(own + name)
    put = lambda df, **cols: df.withColumns({own + k: v for k, v in cols.items()})
    text = F.coalesce(F.col("text"), F.lit(""))
    windows = Windows(c("w"))
    telling = [i for i in range(len(refs.shares)) if refs.telling(i)]
    known = sorted({x for i in telling for x in refs.words[i]})
    # each common word between two spaces of its own, so that it is counted by taking it away
    hit = F.filter(c("w"), lambda x: (F.length(x) <= WORD_LETTERS) & F.lower(x).isin(known))
    spaced = F.array_join(F.transform(hit, lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(" "))), "") if known else F.lit("")

    own_lang = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    df = put(docs, w=words(F.col("text")), lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = put(df, n=F.size(c("w")), joined=F.array_join(c("w"), ""), hashes=windows.hashes())
    df = put(df, rest=rest_of(c("joined")), packed=windows.packed(c("hashes")))
    df = put(df, enough=(c("n") >= LEAST_WORDS) & (F.length(c("joined")) >= LEAST_CHARS), chars=F.length(c("joined")), counts=F.array(*[x.cast("double") for x in class_counts(c("joined"), c("rest"))]), twins=windows.twins(c("packed")))
    df = put(df, repeat=windows.repeated_words(c("twins")), common=F.when(c("enough"), spaced), last=c("chars") - total(c("counts")))
    df = put(df, shares=F.when(c("enough"), F.transform(F.concat(c("counts"), F.array(c("last"))), lambda x: x / F.greatest(c("chars"), F.lit(1)))), failed=(c("n") < 50) | (100 * c("repeat") > 50 * c("n")))

    def nearest(distances: list[Column]) -> Column:
        return F.when(c("enough"), F.least(*distances) if len(distances) > 1 else distances[0]) if distances else F.lit(None).cast("double")

    def word_shares(ws: list[str]) -> Column:
        n = F.greatest(c("n"), F.lit(1))
        found = [(F.length(c("common")) - F.length(F.replace(c("common"), F.lit(f" {x} "), F.lit("")))) / F.lit(len(x) + 2) / n for x in ws]
        return F.when(c("enough"), F.array(*found))

    if len(refs.langs) <= SPELT_OUT:
        df = put(df, **{f"words{i}": word_shares(ws) for i, ws in enumerate(refs.words) if i in telling})
        df = put(df, **{f"words{i}": F.concat(c(f"words{i}"), F.array(1 - total(c(f"words{i}")))) for i, ws in enumerate(refs.words) if i in telling})
        df = put(df, char=nearest([js_distance(c("shares"), q) for q in refs.classes]), word=nearest([js_distance(c(f"words{i}"), refs.shares[i]) * F.lit(WORD_LIMIT / refs.limit(i)) for i in telling]))
    else:
        fixed = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
        classes = fixed(refs.classes, "array<array<double>>")
        told = fixed([{"w": refs.words[i], "s": refs.shares[i], "k": WORD_LIMIT / refs.limit(i)} for i in telling], "array<struct<w: array<string>, s: array<double>, k: double>>")
        df = put(df, hits=F.when(c("enough"), F.transform(hit, F.lower)))
        df = put(df, hits=F.map_from_entries(F.transform(F.array_distinct(c("hits")), lambda x: F.struct(x, F.size(F.filter(c("hits"), lambda y: y == x)))))) if known else put(df, hits=F.lit(None))
        found = lambda r: F.transform(r["w"], lambda x: F.coalesce(F.try_element_at(c("hits"), x), F.lit(0)) / F.greatest(c("n"), F.lit(1)))
        own_words = F.transform(told, lambda r: F.struct(found(r).alias("own"), r["s"].alias("s"), r["k"].alias("k")))
        df = put(df, told=F.when(c("enough"), own_words) if known else F.lit(None))
        word = F.array_min(F.transform(c("told"), lambda r: js_between(F.concat(r["own"], F.array(1 - total(r["own"]))), r["s"]) * r["k"])) if known else F.lit(None).cast("double")
        df = put(df, char=F.when(c("enough"), F.array_min(F.transform(classes, lambda q: js_between(c("shares"), q)))), word=word)
    if len(telling) < len(refs.langs):
        df = put(df, word=F.when(own_lang.isin([refs.langs[i] for i in telling]), c("word")))
    kept = ~c("failed") & F.coalesce(c("char") <= CHAR_LIMIT, F.lit(True)) & F.coalesce(c("word") <= WORD_LIMIT, F.lit(True))
    dup_lines = F.size(c("lines")) - F.size(F.array_distinct(c("lines")))
    found = {"n_words": c("n").cast("long"), "word_chars": c("chars").cast("long"), "n_symbols": F.get(c("counts"), F.lit(3)).cast("long"), "n_dup_lines": dup_lines.cast("long"), "n_repeat_words": c("repeat"), "base_failed": c("failed"), "char_distance": c("char"), "word_distance": c("word"), "kept": kept}
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], F.struct(*[v.alias(k) for k, v in found.items()]).alias(rules))
