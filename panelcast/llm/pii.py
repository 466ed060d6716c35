"""Personal data in texts: rules, and boosted trees that judge further candidates. DataFrame functions only.

Rules find e-mail addresses, IP addresses, card and phone numbers. Looser patterns propose candidates
of the same kinds, which may overlap each other and the rules' spans. Gradient-boosted trees learn
how spans of a kind look and where they stand: from candidates that a rule confirms, from copies of the
rules' spans whose marker is removed or obfuscated (the at sign, the plus sign, usual separators), and
against candidates with contrary evidence (such as a failed Luhn sum). A candidate that no rule confirms
and nothing speaks against is no example of either; it is what the trees are for. Per kind, the least
score at which the held-out copies are told from contrary candidates precisely enough is the threshold;
candidates that reach it, have no contrary evidence and overlap no rule span are added.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.sampling import draw, remainder
from panelcast.session import write_and_read

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 10_000
CANDIDATES = 40_000
TREES = 12
DEPTH = 4
PRECISION = 0.99
LEAST_POSITIVES = 20

# The rules. A run is entered only at its start (or where the last match ended) and consumed without
# backtracking, so scanning is linear; nested atomic groups bound the matcher's recursion on long runs.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
RULES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?>(?>(?>\.{_LABEL}++){{1,64}}){{1,64}})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?>(?>(?>[ -]?[0-9]){1,64}){1,64})++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE_RULES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9])[0-9]{1,5}(?:[.:,][0-9]{1,5}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[ ().-]{0,3}[0-9]){8,14}(?![0-9])",
}
CANDIDATE_HINTS = {"email": r"@|\[at\]|\(at\)", "ip": "[0-9][.:,][0-9]", "card": "[0-9][ .-]?[0-9][ .-]?[0-9]", "phone": "[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9]"}
CONTEXT = {"email": "mail|contact|write|@", "ip": r"\bip\b|host|server|address|addr", "card": "card|visa|credit|pay|account", "phone": "phone|tel|call|fax|mobile|cell"}
FEATURES = ("kind", "chars", "digits", "letters", "marks", "groups", "first_group", "last_group", "brackets", "spaces", "before_blank", "before_letter", "before_mark", "after_blank", "after_letter", "word_before", "colon_before", "hint_before", "digits_before", "digits_after")
_MARK = "\u0001"


def _pieces(text: str, pattern: str, there: Column) -> Column:
    """The text cut before and after every match: matches are the second, fourth, ... piece."""
    return F.when(there, F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)).otherwise(F.array(F.lit("")))


def _ends(pieces: str) -> Column:
    """Where each piece ends, in code points."""
    return F.expr(f"aggregate({pieces}, cast(array() as array<int>), (acc, x) -> cast(concat(acc, array(coalesce(try_element_at(acc, -1), 0) + length(x))) as array<int>))")


def _found(pieces: str, ends: str, kind: int) -> Column:
    """The matches among pieces: start and end in code points, the string, and some text on either side."""
    return F.expr(
        f"case when size({pieces}) < 3 then cast(array() as array<struct<start:int,kind:int,end:int,s:string,before:string,after:string>>) else "
        f"transform(sequence(1, size({pieces}) - 2, 2), i -> named_struct('start', {ends}[i - 1], 'kind', {kind}, 'end', {ends}[i], "
        f"'s', {pieces}[i], 'before', right({pieces}[i - 1], 24), 'after', left({pieces}[i + 1], 16))) end"
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's sum."""
    each = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.filter(each, lambda x: x != ""), value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _valid(kind: str):
    """The test that a match of the kind's rule must pass."""
    if kind == "ip":
        return lambda m: F.forall(F.split(m["s"], r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return lambda m: F.length(_digits(m["s"])).between(12, 19) & luhn(_digits(m["s"]))
    if kind == "phone":
        return lambda m: F.length(_digits(m["s"])).between(9, 15)
    return None


def _scan(docs: DataFrame, text: str, rules: dict[str, str], there: dict[str, Column], prefix: str) -> DataFrame:
    """Adds, per kind, the matches of its rule as ``prefix`` + kind."""
    kept = docs.columns
    d = docs.select("*", *[_pieces(text, rules[k], there[k]).alias(f"_p_{k}") for k in KINDS])
    d = d.select("*", *[_ends(f"_p_{k}").alias(f"_e_{k}") for k in KINDS])
    return d.select(*kept, *[_found(f"_p_{k}", f"_e_{k}", i).alias(prefix + k) for i, k in enumerate(KINDS)])


def with_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds the rules' spans (``b_`` + kind) and the candidates (``c_`` + kind) of ``text``."""
    there = {k: F.contains(F.col(text), F.lit(h)) if h else F.col(text).rlike("[0-9](?:[ -]?[0-9]){11}") for k, h in HINTS.items()}
    d = _scan(docs, text, RULES, there, "b_")
    for k in KINDS:
        if (valid := _valid(k)) is not None:
            d = d.withColumn(f"b_{k}", F.filter(f"b_{k}", valid))
    d = _scan(d, text, CANDIDATE_RULES, {k: F.col(text).rlike(h) for k, h in CANDIDATE_HINTS.items()}, "c_")
    return d


def features(m: Column) -> list[Column]:
    """FEATURES of a span: its format and what stands beside it."""
    s, before, after = m["s"], m["before"], m["after"]
    groups = F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda x: x != "")
    n_letters, n_digits = F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.length(_digits(s))
    last = F.regexp_extract(before, r"([^ \t-\r]*)[ \t-\r]*$", 1)
    hint = F.lit(False)
    for i, k in enumerate(KINDS):
        hint = hint | ((m["kind"] == i) & F.lower(before).rlike(CONTEXT[k]))
    out = (
        m["kind"], F.length(s), n_digits, n_letters, F.length(s) - n_digits - n_letters, F.size(groups), F.length(F.coalesce(F.try_element_at(groups, F.lit(1)), F.lit(""))),
        F.length(F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(""))), F.contains(s, F.lit("(")), F.length(F.regexp_replace(s, "[^ ]", "")),
        (before == "") | before.rlike("[ \\t-\\r]$"), before.rlike(r"\p{L}$"), before.rlike(r"[^ \t-\r\p{L}0-9]$"), (after == "") | after.rlike("^[ \\t-\\r]"), after.rlike(r"^\p{L}"),
        F.length(last), before.rlike("[:=] ?$"), hint, F.length(_digits(before)), F.length(_digits(after)),
    )
    return [c.cast("double").alias(f) for c, f in zip(out, FEATURES, strict=True)]


def _overlaps(spans: str | Column, m: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))


@dataclass(frozen=True)
class Judge:
    """Trees as conditions on FEATURES, with the trees' weights, and the threshold per kind (None: add none)."""

    trees: Sequence[str]
    thresholds: Sequence[float | None]

    def score(self, m: Column) -> Column:
        """Chance that a span is of its kind, from the trees' summed margin."""
        f = F.struct(*features(m))
        margin = F.lit(0.0)
        for tree in self.trees:
            margin = margin + _tree_column(tree, f)
        return 1 / (1 + F.exp(-2 * margin))


def _tree_column(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, split, low, high = tree
    return F.when(f[FEATURES[feature]] <= split, _tree_column(low, f)).otherwise(_tree_column(high, f))


def _trees(model) -> list:
    """The model's trees as nested (feature, threshold, low, high), leaves times the tree's weight."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip()]

        def node(lines=lines, weight=weight):
            x = lines.pop(0)
            if x.startswith("Predict:"):
                return float(x.split(":")[1]) * weight
            feature, split = re.match(r"If \(feature (\d+) <= (\S+)\)", x).groups()
            low = node()
            lines.pop(0)
            return int(feature), float(split), low, node()

        out.append(node())
    return out


def _contrary(kind: str, m: Column) -> Column:
    """Whether a candidate that no rule confirms shows that it is none of its kind."""
    s, before, after = m["s"], m["before"], m["after"]
    if kind == "email":  # no top-level name, or a sentence that ends in between
        return ~s.rlike("[A-Za-z]{2}$") | s.rlike(r"[^ ]\. ")
    if kind == "ip":  # numbers out of range, mixed separators, clock times, thousands, longer series
        high = F.exists(F.split(s, "[.:,]"), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) > 3) | (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") > 255))
        mixed = ~s.rlike(r"^[0-9]+([.:,])[0-9]+\1[0-9]+\1[0-9]+$")
        return high | mixed | s.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]:|^[0-9]{1,3}(,[0-9]{3})+$") | before.rlike("[0-9][.:,]$") | after.rlike("^[.:,][0-9]")
    if kind == "card":
        return ~luhn(_digits(s)) | after.rlike("^[ .-]?[0-9]")
    dates = s.rlike(r"(?<![0-9])(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?![0-9])|(?<![0-9])[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2}(?![0-9])")
    years = s.rlike("(?<![0-9])(19|20)[0-9]{2}[^0-9]{1,3}(19|20)[0-9]{2}(?![0-9])")
    brackets = F.length(F.regexp_replace(s, r"[^(]", "")) != F.length(F.regexp_replace(s, r"[^)]", ""))
    return dates | years | brackets | s.rlike(r"^[0-9]+\.[0-9]+$") | before.rlike(r"[\p{L}0-9_#$€£]$|[0-9][.,:/-]$") | after.rlike(r"^[\p{L}_%]|^[.,:/-]?[0-9]")


def _hidden(kind: str, m: Column) -> Column:
    """A rule's span without its marker, or with it obfuscated, in one of a few ways by its hash."""
    s, way = m["s"], F.pmod(F.xxhash64(m["s"]), F.lit(3))
    if kind == "email":
        spelt = lambda at, dot: F.replace(F.replace(s, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
        out = F.when(way == 0, spelt(" [at] ", " [dot] ")).when(way == 1, spelt("(at)", "(dot)")).otherwise(spelt(" @ ", "."))
    elif kind == "ip":
        out = F.when(way == 0, F.translate(s, ".", ",")).otherwise(F.translate(s, ".", ":"))
    elif kind == "card":
        out = F.regexp_replace(_digits(s), "([0-9]{4})(?=[0-9])", "$1.")
    else:
        out = F.when(way == 0, F.replace(s, F.lit("+"), F.lit("00"))).otherwise(F.replace(s, F.lit("+"), F.lit("")))
    return F.struct(*[(out if c == "s" else m[c]).alias(c) for c in ("start", "kind", "end", "s", "before", "after")])


def _examples(spanned: DataFrame) -> DataFrame:
    """Features and label of confirmed candidates and hidden copies of the rules' spans (1), and of contrary candidates (0).

    ``copy`` tells the copies. Candidates that are neither confirmed nor contrary are left out.
    """

    def judged(k: str) -> Column:
        others = F.concat(*[F.transform(f"b_{x}", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for x in KINDS if x != k])

        def of(m: Column) -> Column:
            return F.when(_overlaps(f"b_{k}", m), 1).when(_contrary(k, m) | _overlaps(others, m), 0)

        told = F.filter(F.transform(f"c_{k}", lambda m: F.struct(m.alias("m"), of(m).alias("label"), F.lit(False).alias("copy"))), lambda c: c["label"].isNotNull())
        copies = F.filter(F.transform(f"b_{k}", lambda m: _hidden(k, m)), lambda m: ~_contrary(k, m))
        return F.concat(told, F.transform(copies, lambda m: F.struct(m.alias("m"), F.lit(1).alias("label"), F.lit(True).alias("copy"))))

    every = F.explode(F.concat(*[judged(k) for k in KINDS])).alias("c")
    return spanned.select(every).select(F.col("c.label").cast("double").alias("label"), F.col("c.copy").alias("copy"), *features(F.col("c.m")))


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Judge:
    """Trees from at most 1.25 x SAMPLE_DOCS documents and CANDIDATES examples, thresholds from all held-out documents.

    Documents are drawn by a hash of the key; those whose crc32 of the key is divisible by 5 are held
    out from the trees and set the thresholds. There a rule's span counts once, as its copy without
    marker, against the contrary candidates. A kind with fewer than LEAST_POSITIVES copies there, or no
    score that reaches PRECISION, gets no threshold and no added spans.
    """
    d = docs.select((remainder(key, 5) == 0).alias("held"), F.col(key).alias("key"), clean(text).alias("_text"))
    found = write_and_read(_examples(with_spans(draw(d.where("not held"), SAMPLE_DOCS, None, "key").repartition("key"))).limit(CANDIDATES), "candidates")
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found).select("features", "label")
    none = Judge((), (None,) * len(KINDS))
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return none
    trees = _trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=3, maxBins=32).fit(train))
    judge = Judge(trees, none.thresholds)
    span = F.struct(*[F.col(f) for f in FEATURES])
    margin = F.lit(0.0)
    for tree in trees:
        margin = margin + _tree_column(tree, span)
    step = F.floor(1000 / (1 + F.exp(-2 * margin))).cast("int")
    held = _examples(with_spans(d.where("held"))).where("copy or label = 0")
    tally = held.groupBy("kind", step.alias("step")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    thresholds: list[float | None] = []
    for i in range(len(KINDS)):
        right = n = 0
        best = None
        for r in sorted((r for r in tally if r["kind"] == i), key=lambda r: -r["step"]):
            right, n = right + r["right"], n + r["n"]
            if right >= LEAST_POSITIVES and right >= PRECISION * n:
                best = r["step"] / 1000
        thresholds.append(best)
    return Judge(judge.trees, tuple(thresholds))


def clean(text: str) -> Column:
    """The text with null as empty, and the marking character as another one that no pattern takes."""
    return F.coalesce(F.translate(F.col(text), _MARK, "\u0003"), F.lit(""))


def find(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind, end) in code points, end exclusive, by start, then kind.

    ``base`` are the rules' spans, ``spans`` these and the added ones. An added span overlaps no other
    span. Null and empty texts have none. Columns pass through, except base and spans, which are
    replaced; rows are judged one by one, so repeats agree; an empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in ("base", "spans")]
    names = {c: f"_in{i}" for i, c in enumerate(columns)}
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], clean(text).alias("_text"))
    d = with_spans(d)
    narrow = lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))
    d = d.withColumn("base", F.array_sort(F.concat(*[F.transform(f"b_{k}", narrow) for k in KINDS]))).withColumn("_all", F.col("base"))
    for k, threshold in zip(KINDS, judge.thresholds, strict=True):
        if threshold is not None:
            free = F.filter(f"c_{k}", lambda m: ~_overlaps("_all", m) & ~_contrary(k, m))
            d = d.withColumn(f"_f_{k}", free)
            good = _at_least(f"_f_{k}", judge, threshold)
            d = d.withColumn("_all", F.when(F.size(f"_f_{k}") > 0, F.concat("_all", F.transform(good, narrow))).otherwise(F.col("_all")))
    return d.select(*[F.col(n).alias(c) for c, n in names.items()], "base", F.array_sort("_all").alias("spans"))


def _at_least(spans: str, judge: Judge, threshold: float) -> Column:
    return F.filter(spans, lambda m: judge.score(m) >= threshold)


def count(spans: str, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda m: m["kind"] == kind)).cast("long")


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kind, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def redact(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    d = find(docs, judge, text)
    kind = F.array(*[F.lit(k) for k in KINDS])
    step = lambda acc, m: F.struct(
        F.when(m["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit("<"), F.get(kind, m["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], m["end"]).alias("at"),
    )
    body = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return d.withColumn(text, F.when(F.size("spans") > 0, body).otherwise(F.col(text)))
