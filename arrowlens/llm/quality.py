"""Per-document text statistics and, from them, the form of a text: prose, list, table or junk.

The statistics are one JVM-side projection over whole texts: characters by kind, one pass over the lines and one over
the words. An ordered rule list over them is induced by incremental reduced-error pruning (`irep`): a rule is grown on
two thirds of the labelled documents by the condition with most information gain at a time, each threshold is moved to
the middle of the gap that it cuts, then the last conditions are cut off again as long as that serves the other third;
the documents it covers leave the sample, and the next rule is grown, until three rules in a row err more often than
not. What no rule covers is prose. A rule for junk needs signs of two families at least (SIGNS): what it reads off
letters and symbols, off clusters of consonants, words without vowels, spacing, repetition and the like. The learned
thresholds are exported to one SQL CASE expression, which Spark applies natively to all documents.

The labels come from the labelling functions in `teacher`, over at most MAX_LABELLED documents (`fit`), and from
natural paragraphs of many languages in `anchors`. The fitted list lies in quality_rules.json.

Defined results: a null, empty or blank text has counts of 0, null for all shares and means, and no form.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, functions as F

#: Bound of the labelled sample that rules are fitted on, and of the common words (they become one expression).
MAX_LABELLED, MAX_COMMON = 20_000, 5_000
RULES = os.path.join(os.path.dirname(__file__), "quality_rules.json")
CLASSES = ("prose", "list", "table", "junk")

_BREAK = r"[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]+"
_TABLE = "|".join(
    [
        r"(?i:</?(?:table|tr|td|th|tbody|thead)\b)",
        r"^\s*[+|][-=+|: ]{3,}\s*$",
        r"^\s*\|.*\|\s*$",
        r"^(?:\S+(?: \S+){0,2})? *(?:\t *(?:\S+(?: \S+){0,2})? *)+$",
        r"^\s*[^\s,]*(?:,[^\s,]*){2,}\s*$",
        r"^\s*[^\s;]*(?:;[^\s;]*){2,}\s*$",
        r"^\s*\S+(?: {2,}\S+)+\s*$",
    ]
)
_MARK = r"^\s*(?:[-*+•–—◦▪‣·]\s+|\[[ xX]\]\s|#?\(?\d{1,3}[.):]?\s+(?=\S)|\(?[a-zA-Z\d]{1,3}[.)]\s)"
_CONSONANTS = "bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщ"
_ECHO = r"(?<![\p{L}\p{N}])([\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+)?)[^\p{L}\p{N}]+\1(?![\p{L}\p{N}])"
#: Scripts that write words without spaces between them.
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_SHORT = r"^\s*\S+(?:\s+\S+){0,5}\s*$"
_ENDED = r"[.!?:;…。！？\"”)]\s*$"
_INLINE = r"^[^,;|]{0,60}(?:(?:, |; | / | \| )[^,;|!?]{1,30}){4,}[.;]?\s*$"

STATISTICS = (
    "n_chars", "n_words", "n_lines", "mean_word", "symbol_ratio", "punct_lines", "common_share",
    "table_share", "mark_share", "short_share", "inline_share", "letter_ratio", "digit_ratio", "broken_ratio",
    "unspaced_ratio", "list_share", "single_share", "long_share", "pair_share", "distinct_words", "richness",
    "vowelless_share", "cluster_share", "gap_share", "run_share", "mixed_share", "variety", "echo_share", "word_rate",
)
#: What rules may test; sizes and the share of punctuated lines are reported but say little about form.
TESTED = tuple(n for n in STATISTICS if n not in ("n_chars", "n_words", "n_lines", "punct_lines", "mark_share", "short_share", "distinct_words", "unspaced_ratio", "richness"))
#: Signs of junk: which statistic points to it in which direction, and its family. Signs of one family are no
#: independent signs of each other, and few frequent words are none at all: they may mean another language.
SIGNS = {
    "letter_ratio": ("<=", "letters"), "symbol_ratio": (">=", "letters"), "digit_ratio": (">=", "letters"),
    "broken_ratio": (">=", "broken"), "long_share": (">=", "length"), "word_rate": ("<=", "length"), "pair_share": (">=", "pairs"),
    "single_share": (">=", "single"), "gap_share": (">=", "gaps"), "vowelless_share": (">=", "hollow"),
    "cluster_share": (">=", "clusters"), "variety": ("<=", "repetition"), "echo_share": (">=", "echo"), "run_share": (">=", "runs"),
    "mixed_share": (">=", "mixture"), "common_share": ("<=", None),
}


def common_words(words: DataFrame) -> list[str]:
    rows = words.select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(r["w"] for r in rows)


def _sum_lines(lines: Column) -> Column:
    """Sums over lines; each pattern is tried once a line, then only flags are added up."""
    names = ("lines", "ended", "chars", "table", "mark", "short", "inline", "item")
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))
    seen = F.transform(
        lines,
        lambda x: F.struct(
            F.length(x).cast("long").alias("n"),
            x.rlike(_ENDED).alias("ended"),
            x.rlike(_INLINE).alias("inline"),
            x.rlike(_TABLE).alias("table"),
            x.rlike(_MARK).alias("mark"),
            x.rlike(_SHORT).alias("short"),
        ),
    )

    def add(acc: Column, x: Column) -> Column:
        take = lambda ok: F.when(ok, x["n"]).otherwise(F.lit(0).cast("long"))
        table = x["table"] & ~x["inline"]
        mark, short = ~table & x["mark"], ~table & x["short"] & ~x["ended"]
        more = (F.lit(1).cast("long"), x["ended"].cast("long"), x["n"], take(table), take(mark), take(short), take(x["inline"]), take(mark | short | x["inline"]))
        return F.struct(*((acc[n] + m).alias(n) for n, m in zip(names, more)))

    return F.aggregate(seen, zero, add)


def _sum_words(words: Column, common: list[str]) -> Column:
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("words", "chars", "common", "single", "pair")))

    def add(acc: Column, x: Column) -> Column:
        n = F.length(x).cast("long")
        return F.struct(
            (acc["words"] + 1).alias("words"),
            (acc["chars"] + n).alias("chars"),
            (acc["common"] + (x.isin(common) if common else F.lit(False)).cast("long")).alias("common"),
            (acc["single"] + (n == 1).cast("long")).alias("single"),
            (acc["pair"] + ((n == 2) & x.rlike("^[0-9a-f]{2}$")).cast("long")).alias("pair"),
        )

    return F.aggregate(words, zero, add)


def statistics(docs: DataFrame, common: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the columns of STATISTICS for each document.

    A word is a run of letters, marks and digits; symbols are what is neither that nor white space. Shares of lines
    and words are by number, table_share and the like by characters of lines that are not blank.
    """
    t = F.col("text")
    only = lambda keep_class: F.length(F.regexp_replace(t, rf"[^{keep_class}]+", ""))
    count = lambda pattern, c: F.regexp_count(c, F.lit(pattern))
    blank = t.isNull() | ~t.rlike(r"[^\s\p{Z}\x{FEFF}\x{200B}]")
    solid = F.when(~F.col("blank"), t)
    lower, lines, words, variety = F.col("low"), F.col("lines"), F.col("words"), F.col("distinct")
    parts = F.struct(
        F.lower(t).alias("low"),
        F.filter(F.split(solid, _BREAK), lambda x: x.rlike(r"[^\s\p{Z}]")).alias("lines"),
        F.filter(F.split(F.lower(solid), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "").alias("words"),
    )
    # each inline keeps Catalyst from copying what it holds into every use: texts are cut into lines and words once
    first = docs.select(*keep, "text", F.inline(F.array(F.struct(blank.alias("blank")))))
    first = first.select(*keep, "text", "blank", F.inline(F.array(parts)))
    first = first.select("*", F.inline(F.array(F.struct(F.when(~F.col("blank"), F.size(F.array_distinct(words))).alias("distinct")))))
    sums = F.struct(
        F.coalesce(F.length("text"), F.lit(0)).alias("n"),
        _sum_lines(lines).alias("l"),
        _sum_words(words, common).alias("w"),
        variety.alias("distinct"),
        only(r"\p{L}\p{M}").alias("letters"),
        only(r"\p{N}").alias("digits"),
        only(r"\s\p{Z}").alias("spaces"),
        F.when(t.rlike(f"[{_UNSPACED}]"), only(_UNSPACED)).otherwise(0).alias("unspaced"),
        # marks in the middle of words, where no language has them, and replacement marks
        count(r"(?<=\p{L})[?\x{FFFD}\x{20AC}\xBF\xA4]+(?=\p{L})|\x{FFFD}|[\xC2\xC3\xE2][?\x{FFFD}\x{20AC}\xBF\xC2\xC3\xE2]", t).alias("broken"),
        count(rf"[{_CONSONANTS}]{{5,}}", lower).alias("clusters"),
        count(rf"(?<![\p{{L}}\p{{M}}])[{_CONSONANTS}]{{3,}}(?![\p{{L}}\p{{M}}])", lower).alias("vowelless"),
        count(r"\S {2,}(?=\S)", t).alias("gaps"),
        count(r"[a-z][0-9]|[0-9][a-z]", lower).alias("mixed"),
        # words or pairs of words said again at once, where few words differ at all
        F.when(variety < 25, count(_ECHO, lower)).otherwise(0).alias("echoes"),
        (F.length("text") - F.length(F.regexp_replace(t, r"(\S)\1{5,}", ""))).alias("runs"),
        (F.length("text") - F.length(F.regexp_replace(t, r"\S{40,}", ""))).alias("long"),
    )
    # inline keeps Catalyst from copying the sums into every share, and into filters on the form, that uses them
    counted = first.select(*keep, "blank", F.inline(F.array(sums)))
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    solid_n = c("n") - c("spaces")
    spaced = ~c("blank") & (c("unspaced") * 4 < solid_n)
    of_words = lambda n: F.when(spaced, F.coalesce(ratio(c(n).cast("double"), c("w.words")), F.lit(0.0)))
    return counted.select(
        *keep,
        c("n").cast("long").alias("n_chars"),
        F.coalesce(c("w.words"), F.lit(0)).alias("n_words"),
        F.coalesce(c("l.lines"), F.lit(0)).alias("n_lines"),
        ratio(c("w.chars"), c("w.words")).alias("mean_word"),
        F.when(~c("blank"), ratio(solid_n - c("letters") - c("digits"), solid_n)).alias("symbol_ratio"),
        ratio(c("l.ended"), c("l.lines")).alias("punct_lines"),
        of_words("w.common").alias("common_share"),
        ratio(c("l.table"), c("l.chars")).alias("table_share"),
        ratio(c("l.mark"), c("l.chars")).alias("mark_share"),
        ratio(c("l.short"), c("l.chars")).alias("short_share"),
        ratio(c("l.inline"), c("l.chars")).alias("inline_share"),
        F.when(~c("blank"), ratio(c("letters"), solid_n)).alias("letter_ratio"),
        F.when(~c("blank"), ratio(c("digits"), solid_n)).alias("digit_ratio"),
        F.when(~c("blank"), ratio(c("broken"), solid_n)).alias("broken_ratio"),
        F.when(~c("blank"), ratio(c("unspaced"), solid_n)).alias("unspaced_ratio"),
        ratio(c("l.item"), c("l.chars")).alias("list_share"),
        ratio(c("w.single"), c("w.words")).alias("single_share"),
        F.when(spaced, ratio(c("long"), solid_n)).alias("long_share"),
        ratio(c("w.pair"), c("w.words")).alias("pair_share"),
        c("distinct").cast("long").alias("distinct_words"),
        F.when(spaced, ratio(c("distinct"), F.sqrt(c("w.words")))).alias("richness"),
        of_words("vowelless").alias("vowelless_share"),
        of_words("clusters").alias("cluster_share"),
        of_words("gaps").alias("gap_share"),
        F.when(~c("blank"), ratio(c("runs"), solid_n)).alias("run_share"),
        of_words("mixed").alias("mixed_share"),
        F.when(spaced, ratio(c("distinct").cast("double"), F.least(c("w.words"), F.lit(50)))).alias("variety"),
        of_words("echoes").alias("echo_share"),
        F.when(spaced, F.coalesce(ratio(c("w.words").cast("double"), solid_n), F.lit(0.0))).alias("word_rate"),
    )


def irep(x, y, names, order=("table", "junk", "list"), default="prose", seed: int = 7, most: int = 24, signs=(("junk", 2, SIGNS),)):
    """Ordered rules [(class, [(statistic, '>=' or '<=', threshold), ...]), ...] from a matrix and labels.

    Statistics that are missing (NaN) meet no condition. `signs` names classes whose rules take conditions only in the
    directions given for each statistic, and need so many families of them.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    left = np.ones(len(y), bool)
    rules, bound = [], {label: (n, known) for label, n, known in signs}

    def meets(j, op, t):
        return (x[:, j] >= t) if op == ">=" else (x[:, j] <= t)

    def cover(conds, rows):
        ok = rows.copy()
        for c in conds:
            ok &= meets(*c)
        return ok

    def centred(j, op, t, rows, pos):
        """The threshold in the middle between what is inside and the nearest of the other classes outside."""
        inside, outside = rows & meets(j, op, t) & pos, rows & ~meets(j, op, t) & ~pos & ~np.isnan(x[:, j])
        if not inside.any() or not outside.any():
            return j, op, t
        a, b = (x[inside, j].min(), x[outside, j].max()) if op == ">=" else (x[inside, j].max(), x[outside, j].min())
        return (j, op, float((a + b) / 2)) if (a > b) == (op == ">=") else (j, op, t)

    def families(conds, known):
        return {known[names[j]][1] for j, *_ in conds} - {None} if known else set()

    def grow(rows, pos, need, known):
        conds: list[tuple[int, str, float]] = []
        now = rows.copy()
        while len(conds) < 6:
            p0, n0 = (now & pos).sum(), (now & ~pos).sum()
            if n0 == 0 or p0 == 0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
            idx = np.flatnonzero(now)
            is_pos = pos[idx]
            for j in range(x.shape[1]):
                if known and names[j] not in known:
                    continue
                v = x[idx, j]
                ok = ~np.isnan(v)
                if not ok.any():
                    continue
                cuts = np.unique(np.concatenate([np.quantile(v[ok], np.linspace(0, 1, 65)), np.quantile(v[ok & is_pos], np.linspace(0, 1, 33)) if (ok & is_pos).any() else v[:0]]))
                for t in (cuts[1:] + cuts[:-1]) / 2:
                    for op, hit in ((">=", v >= t), ("<=", v <= t)):
                        if known and (known[names[j]][0] != op or t <= 0):
                            continue
                        p = (hit & is_pos).sum()
                        n = (hit & ~is_pos).sum()
                        if p and (gain := p * (np.log2(p / (p + n)) - base)) > best[0]:
                            best = (gain, (j, op, float(t)))
            if best[1] is None:
                break
            conds.append(centred(*best[1], now, pos))
            now = cover(conds, rows)
        while conds and len(families(conds, known)) < need:
            extra = second(cover(conds, rows) & pos, rows & ~pos, families(conds, known), known)
            if extra is None:
                return []
            conds.insert(1, extra)
        return conds

    def second(covered, others, taken, known):
        """The sign of another family that tells most of the covered rows from all rows of the other classes, with its
        threshold in the middle between these and what is usual there."""
        best, n_others, n_covered = (0.0, None), max(1, others.sum()), covered.sum()
        base = np.log2(n_covered / (n_covered + n_others))
        for j in range(x.shape[1]):
            op, family = known.get(names[j], (None, None))
            if family is None or family in taken:
                continue
            v, w = x[covered, j], x[others, j]
            if np.isnan(v).all():
                continue
            usual = float(np.nanquantile(w, 0.9975 if op == ">=" else 0.0025))
            for q in (0.05, 0.1, 0.25, 0.5):
                t = float(np.nanquantile(v, q if op == ">=" else 1 - q))
                t = (t + usual) / 2 if (t > usual) == (op == ">=") else t
                if t <= 0:
                    continue
                p, n = ((v >= t).sum(), (w >= t).sum()) if op == ">=" else ((v <= t).sum(), (w <= t).sum())
                if p and (gain := p * (np.log2(p / (p + n)) - base)) > best[0]:
                    best = (gain, (j, op, t))
        return best[1]

    for label in order:
        pos = y == label
        failed, (need, known) = 0, bound.get(label, (0, {}))
        for _ in range(most):
            if failed == 3 or not (left & pos).any():
                break
            part = rng.random(len(y)) < 2 / 3
            conds = grow(left & part, pos, need, known)
            test = left & ~part
            P, N = (test & pos).sum(), (test & ~pos).sum()

            def worth(k, conds=conds, test=test, P=P, N=N):
                c = cover(conds[:k], test)
                return ((c & pos).sum() + N - (c & ~pos).sum()) / max(1, P + N)

            allowed = [k for k in range(1, len(conds) + 1) if len(families(conds[:k], known)) >= need]
            if not allowed:
                failed += 1
                continue
            k = max(allowed, key=lambda k: (worth(k), k))
            conds = conds[:k]
            c = cover(conds, test)
            if (c & pos).sum() <= max(2, (c & ~pos).sum()):
                failed += 1
                continue
            failed = 0
            rules.append((label, [(names[j], op, t) for j, op, t in conds]))
            left &= ~cover(conds, left)
    return {"default": default, "rules": [{"form": f, "if": [list(c) for c in conds]} for f, conds in rules]}


def case_sql(fitted: dict) -> str:
    """The rule list as one SQL CASE expression over the statistics; a text without statistics has no form."""
    whens = [f"WHEN {' AND '.join(f'{n} {op} {t!r}D' for n, op, t in r['if'])} THEN '{r['form']}'" for r in fitted["rules"]]
    return f"CASE WHEN symbol_ratio IS NULL THEN NULL {' '.join(whens)} ELSE '{fitted['default']}' END"


def load_rules(path: str = RULES) -> dict:
    with open(path) as f:
        return json.load(f)


def with_form(stats: DataFrame, fitted: dict | None = None) -> DataFrame:
    return stats.withColumn("form", F.expr(case_sql(fitted or load_rules())))


def fit(docs: DataFrame, words: DataFrame, seed: int = 7, tries: int = 8) -> tuple[dict, dict[str, tuple[float, float]]]:
    """Rules and, on a fifth of the labelled documents that was held out, precision and recall of each class.

    So that length alone does not make junk of a text, each other labelled document that is not junk stands in the
    sample a second time as if it were 16 times as long. Anchors stand in it as often as makes them a tenth.
    Of several lists, grown on different splits, the one stays that is best on the held-out documents and the anchors.
    """
    import numpy as np

    from arrowlens.llm.anchors import JUNK, PROSE
    from arrowlens.llm.teacher import form_of

    common = common_words(words)

    @F.pandas_udf("string")
    def label(text):
        return text.map(form_of)

    solid = docs.where(r"text RLIKE '[^\\s\\p{Z}]'").select("doc_id", "text").withColumn("label", label("text")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    pdf = statistics(solid, common, ("doc_id", "label")).toPandas()
    anchors = docs.sparkSession.createDataFrame([(-i, t) for i, t in enumerate([*PROSE, *JUNK], 1)], "doc_id long, text string")
    # once with the frequent words and once as if none of their language were known
    extra = np.concatenate([statistics(anchors, c).orderBy(F.desc("doc_id")).toPandas()[list(TESTED)].to_numpy(float) for c in (common, [])])
    x, y = pdf[list(TESTED)].to_numpy(float), pdf["label"].to_numpy(str)
    held = np.arange(len(y)) % 5 == 0
    # a text that goes on for 16 times its length with the same words keeps its form; of what is tested only variety falls
    longer = x[~held & (y != "junk")].copy()
    few = pdf[~held & (y != "junk")]
    longer[:, TESTED.index("variety")] = np.where(np.isnan(longer[:, TESTED.index("variety")]), np.nan, few["distinct_words"] / np.minimum(16 * few["n_words"], 50))
    forms = np.tile(np.array(["prose"] * len(PROSE) + ["junk"] * len(JUNK)), 2)
    times = max(1, len(y) // (10 * len(extra)))
    extra = np.repeat(extra, times, axis=0)
    known_y = np.concatenate([y[~held], y[~held & (y != "junk")], np.repeat(forms, times)])
    sample = np.concatenate([x[~held], longer, extra])
    found = [irep(sample, known_y, TESTED, seed=seed + i) for i in range(tries)]
    anchored = np.repeat(forms, times)

    def worth(fitted):
        got = apply_rules(fitted, x[held])
        return min((got[y[held] == c] == c).mean() for c in CLASSES if (y[held] == c).any()) + (apply_rules(fitted, extra) == anchored).mean()

    fitted = max(found, key=worth)
    got, want = apply_rules(fitted, x[held]), y[held]
    figures = {c: (float((want[got == c] == c).mean()) if (got == c).any() else 1.0, float((got[want == c] == c).mean()) if (want == c).any() else 1.0) for c in CLASSES}
    return fitted, figures


def apply_rules(fitted: dict, x):
    """The rule list in numpy over the columns of TESTED, for measuring."""
    import numpy as np

    out = np.full(len(x), "", dtype="<U8")
    for r in fitted["rules"]:
        ok = out == ""
        for n, op, t in r["if"]:
            v = x[:, TESTED.index(n)]
            ok &= (v >= t) if op == ">=" else (v <= t)
        out[ok] = r["form"]
    out[out == ""] = fitted["default"]
    return out
