"""Texts cut off by field limits or in transfer: censored length distributions and the evidence of endings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

# --- candidate limits and their censoring posterior ---

#: Bins of the logarithm of length per unit of it; the fit sees bins, so its input is bounded for any source.
BINS = 24


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, upper, 1 - upper)


def fit_censored(at: np.ndarray, n: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of the log length by maximum likelihood (EM), `censored` rows being only known to be longer."""
    mean = float(np.average(at, weights=n))
    dev = max(0.05, float(np.sqrt(np.average((at - mean) ** 2, weights=n))))
    for _ in range(rounds):
        z = (at - mean) / dev
        hazard = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / np.maximum(_tail(z), 1e-12)
        first = np.where(censored, mean + dev * hazard, at)
        second = np.where(censored, dev * dev * (1 + z * hazard - hazard * hazard) + first**2, at**2)
        mean = float(np.average(first, weights=n))
        dev = max(0.05, float(np.sqrt(max(np.average(second, weights=n) - mean * mean, 0.0))))
    return mean, dev


def _lognormal(at: np.ndarray, n: np.ndarray, censored: np.ndarray) -> tuple[float, np.ndarray]:
    """(log likelihood, density at each length) of the censored log-normal fit."""
    mean, dev = fit_censored(np.log(at), n, censored)
    z = (np.log(at) - mean) / dev
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / (dev * at)
    return float(np.sum(n * np.log(np.maximum(np.where(censored, _tail(z), density), 1e-300)))), density


def _weibull(at: np.ndarray, n: np.ndarray, censored: np.ndarray) -> tuple[float, np.ndarray]:
    """The same of the censored Weibull fit; its shape solves the score equation by bisection."""
    top = at.max()
    x, seen = at / top, ~censored
    known = max(1e-9, float(n[seen].sum()))
    mean_log = float((n[seen] * np.log(x[seen])).sum()) / known if seen.any() else 0.0
    low, high = 0.05, 50.0
    for _ in range(80):
        k = (low + high) / 2
        w = n * x**k
        if float((w * np.log(x)).sum() / w.sum()) - 1 / k - mean_log < 0:
            low = k
        else:
            high = k
    k = (low + high) / 2
    scale = (float((n * x**k).sum()) / known) ** (1 / k)
    h = (x / scale) ** k
    density = k / (scale * top) * (x / scale) ** (k - 1) * np.exp(-h)
    return float(np.sum(n * np.where(censored, -h, np.log(np.maximum(density, 1e-300))))), density


def _limits_of_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Posterior that a value at a candidate limit was cut there: what the likelier fit doesn't explain of the spike."""
    source, unit = key
    length, n = rows["length"].to_numpy(float), rows["n"].to_numpy(float)
    spike = rows["spike"].to_numpy(bool)
    density = max((fit(length, n, spike) for fit in (_lognormal, _weibull)), key=lambda f: f[0])[1]
    natural = n.sum() * density[spike]
    posterior = np.clip(1 - natural / n[spike], 0.001, 0.999)
    return pd.DataFrame({"source": source, "unit": unit, "length": length[spike].astype("int64"), "posterior": posterior})


def censoring_limits(sizes: DataFrame, least: int = 5, times: float = 4.0) -> DataFrame:
    """(source, unit, length, posterior) of lengths where a source's values pile up, in characters and in bytes.

    A length is a candidate if at least `least` values have it and more than `times` the mean of the lengths within
    8 of it (plus one). Counts per length are made before anything is gathered; a source then hands its fit one row
    per candidate and per bin of log length, however many values it has.
    """
    each = sizes.select("source", "text_id", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).alias("length")) for u, c in (("chars", "n_chars"), ("bytes", "n_bytes"))])).alias("s"))
    # texts that are the same throughout say nothing about a limit
    counts = each.where("s.length > 0").select("source", "s.unit", "s.length", "text_id").distinct().groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-8, 8)
    near = (F.sum("n").over(around) - F.col("n")) / 16
    marked = counts.withColumn("near", near).withColumn("spike", (F.col("n") >= least) & (F.col("n") > times * (F.col("near") + 1)))
    bin_at = F.when(F.col("spike"), F.col("length").cast("double")).otherwise(F.exp((F.floor(F.log("length") * BINS) + 0.5) / BINS))
    binned = marked.groupBy("source", "unit", "spike", bin_at.alias("length")).agg(F.sum("n").alias("n"))
    return binned.groupBy("source", "unit").applyInPandas(_limits_of_source, "source string, unit string, length bigint, posterior double")


# --- evidence of endings ---

_MASK = re.compile(r"(?<!\w)(?:\w*\d[\w.:%/-]*|\w+(?:-\w+)+)")
_MARKER = re.compile(r"\s*(?:\[\s*(?:message |text |content |output )?(?:truncated|cut|clipped|snipped|shortened|more|…|\.\.\.)[^\]]*\]|\((?:truncated|cut|continued|cont\.)\)|<truncated>|…|\.{3,}|\[\.\.\.\])\s*$", re.I)
_SAID_CUT = re.compile(r"(?i)truncat|clipped|cut off")
_STOP = re.compile(r"[.!?。！？]+[\"'”»)\]*_`]*$")
_EDGE = "\"'“”«»()[]{}*_`>,.;:!?…"


def _tokens(line: str) -> list[tuple[str, bool]]:
    """Masked words of a line and whether a sentence ends behind them; numbers and hyphenated names are one word each."""
    found = []
    for raw in _MASK.sub("#", line).split():
        word = raw.strip(_EDGE)
        if word:
            found.append((word, bool(_STOP.search(raw))))
        elif found and _STOP.search(raw):
            found[-1] = (found[-1][0], True)
    return found


def _grams(found: list[tuple[str, bool]], i: int) -> tuple[str, str, str]:
    """Sequences of three, two and one words up to place i; a sentence's start stands as ^."""
    w0 = found[i][0]
    w1 = found[i - 1][0] if i > 0 and not found[i - 1][1] else "^"
    w2 = found[i - 2][0] if i > 1 and w1 != "^" and not found[i - 2][1] else "^"
    return f"3 {w2} {w1} {w0}", f"2 {w1} {w0}", f"1 {w0}"


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequences of three words inside texts: how often a line ends behind them without a stop, and how often not.

    Only endings without a stop are judged, so a stop behind the words counts as going on: what is cut before it lacks it.
    """
    ends: Counter = Counter()
    goes: Counter = Counter()

    def told() -> pd.DataFrame:
        keys = list(ends.keys() | goes.keys())
        frame = pd.DataFrame({"gram": keys, "n_end": [ends[k] for k in keys], "n_on": [goes[k] for k in keys]})
        ends.clear()
        goes.clear()
        return frame

    for batch in batches:
        for text in batch["text"]:
            lines = text.split("\n")
            for k, line in enumerate(lines):
                found = _tokens(line)
                last = len(found) - 1
                w2 = w1 = "^"
                for i, (word, stops) in enumerate(found):
                    if i == last and k == len(lines) - 1 and not stops:
                        break  # the text's own ending is what is judged
                    (ends if i == last and not stops else goes)[f"3 {w2} {w1} {word}"] += 1
                    w2, w1 = ("^", "^") if stops else (w1, word)
                if len(ends) + len(goes) > HELD_GRAMS:  # counts are summed later, so they may be handed over at any time
                    yield told()
    if ends or goes:
        yield told()


#: Distinct sequences that a task holds before it hands its counts over.
HELD_GRAMS = 500_000

_PARTS = "doc_id bigint, source string, n_chars bigint, n_bytes bigint, text_id bigint, sign string, g3 string, g2 string, g1 string, c2 string"

#: What an ending looks like, and what is known of it beforehand: certainly cut, certainly whole, or the log odds that the
#: estimate starts from.
CERTAIN = {"said": True, "broken": True, "stops": False, "fence": False, "row": False, "blank": False}
STARTS = {"plain": 0.0, "dots": 0.5, "space": 3.0, "opened": 2.0, "dots-opened": 2.5, "space-opened": 4.0, "in-fence": 3.0, "in-row": 3.0}


def _sign(text: str) -> tuple[str, str]:
    """The look of an ending, and the text without a mark of a cut."""
    rest, mark = text, ""
    if text.endswith("\ufffd"):
        return "broken", text
    if m := _mark_at_end(text):
        rest = text[: m.start()]
        if _SAID_CUT.search(m.group()):
            return "said", rest
        mark = "dots"
    elif text != text.rstrip(" \t"):
        mark = "space"
    last = rest.rstrip("\n").split("\n")[-1].strip()
    if sum(line.lstrip().startswith("```") for line in rest.split("\n")) % 2:
        return "in-fence", rest
    if last.startswith("```"):
        return "fence", rest
    if last.startswith("|") and "|" in last[1:]:
        return ("row" if last.endswith("|") else "in-row"), rest
    if not last:
        return "blank", rest
    if not mark == "dots" and _STOP.search(last):
        return "stops", rest
    opened = last.count('"') % 2 or last.count("(") > last.count(")") or last.count("[") > last.count("]") or last.count("`") % 2
    return "-".join(x for x in (mark, "opened" if opened else "") if x) or "plain", rest


def _mark_at_end(text: str) -> re.Match | None:
    """A mark of a cut at the very end, however long it is."""
    bare = text.rstrip()
    if not bare or bare[-1] not in "])>….":
        return None
    # a mark stands on the last line and holds no other bracket, so it begins at the last opening one, or at the dots
    start = max(bare.rfind("["), bare.rfind("("), bare.rfind("<")) if bare[-1] in "])>" else len(bare.rstrip("….")) if not bare.endswith("[...]") else bare.rfind("[")
    return _MARKER.match(text, max(0, start)) if start >= 0 else None


def ending_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, source, text, text_id in zip(batch["doc_id"], batch["source"], batch["text"], batch["text_id"]):
            sign, rest = _sign(text)
            final = rest.rstrip().split("\n")[-1].rstrip() if rest.strip() else ""
            found = _tokens(final) if sign not in CERTAIN else []
            g3, g2, g1 = _grams(found, len(found) - 1) if found else (None, None, None)
            c2 = _grams(found, len(found) - 2)[1] if len(found) > 1 and not found[-2][1] else None
            rows.append((doc_id, source, len(text), len(text.encode("utf-8", "replace")), text_id, sign, g3, g2, g1, c2))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARTS.split(", ")])


def _goes_on(n: dict[str, Column], usual: Column) -> Column:
    """Probability that a sentence goes on behind the last words: each order leans on the next shorter one, none has a threshold."""
    p = usual
    for order in ("g1", "g2", "g3"):
        p = (n[order]["n_on"] + p) / (n[order]["n_on"] + n[order]["n_end"] + n[order]["others"] + 1)
    return p


def ending_classes(docs: DataFrame, base_rate: float = 0.02) -> DataFrame:
    """doc_id, source, n_chars, n_bytes, text_id, sign and `words`: the look of the ending and what its last words say.

    The last words are looked up among the word sequences inside all distinct texts: do lines end behind them or go
    on? Other texts that end in them count as ends, as far as they are
    more than cuts at `base_rate` bring together by chance. Copies are one text. A cut falls behind any words, an end behind
    those that end lines: `words` is the logarithm of the ratio of these two chances, in steps of a half, or
    `new` for a last word that occurs nowhere else, with whether sentences go on before it.
    """
    texts = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.xxhash64("text").alias("text_id"))
    # both are read several times below: written once, the texts are scanned twice in all
    parts = cut_lineage(texts.mapInPandas(ending_parts, _PARTS))
    slots = ("g3", "g2", "g1", "c2")
    once = parts.where("g1 is not null").groupBy("text_id").agg(*[F.any_value(g).alias(g) for g in slots])
    asked = once.select("text_id", F.explode(F.array(*[F.struct(F.lit(g).alias("slot"), F.col(g).alias("gram")) for g in slots])).alias("k")).select("text_id", "k.slot", "k.gram").where("gram is not null")
    everything = docs.sparkSession.range(1).select(F.lit("0").alias("gram"), F.lit(0).cast("bigint").alias("n_texts"))
    ending = asked.groupBy("gram").agg(F.count_if(F.col("slot") != "c2").alias("n_texts")).unionByName(everything)
    threes = texts.dropDuplicates(["text_id"]).select("text").mapInPandas(gram_counts, "gram string, n_end bigint, n_on bigint").groupBy("gram").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))
    # shorter sequences are sums of longer ones: only those of three words are counted in the texts
    shorter = lambda c: F.array(c, F.concat(F.lit("2 "), F.substring_index(c, " ", -2)), F.concat(F.lit("1 "), F.substring_index(c, " ", -1)), F.lit("0"))
    counts = threes.select(F.explode(shorter(F.col("gram"))).alias("gram"), "n_end", "n_on").join(ending.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))
    known = cut_lineage(ending.join(counts, "gram", "left").fillna(0, ["n_end", "n_on"]))
    all_on, all_end = known.where("gram = '0'").select("n_on", "n_end").first()
    usual = F.lit((all_on + 1) / (all_on + all_end + 2))
    # cuts of so many texts fall behind the same words by chance; only what exceeds that speaks for a natural ending
    cuts_a_word = base_rate * parts.agg(F.approx_count_distinct("text_id")).first()[0] / (all_on + all_end + 1)
    chance = F.lit(cuts_a_word) * (F.col("n_on") + F.col("n_end") + 1)
    others = F.greatest(F.lit(0.0), F.col("n_texts") - 2 - chance - 2 * F.sqrt(chance))
    said = asked.join(known, "gram").groupBy("text_id").agg(*[F.max(F.when(F.col("slot") == g, F.struct("n_on", "n_end", others.alias("others")))).alias(g) for g in slots])
    none = F.struct(F.lit(0).cast("bigint").alias("n_on"), F.lit(0).cast("bigint").alias("n_end"), F.lit(0.0).alias("others"))
    n = {g: F.coalesce(F.col(g), none) for g in slots}
    p = _goes_on(n, usual)
    odds = F.round(2 * (F.log(1 - usual) - F.log(1 - p))).cast("int")
    new = n["g1"]["n_on"] + n["g1"]["n_end"] == 0
    before = F.when(n["c2"]["n_on"] > n["c2"]["n_end"], "on").when(n["c2"]["n_on"] + n["c2"]["n_end"] > 0, "end").otherwise("unknown")
    kind = F.when(F.col("last").rlike("[\\d#]"), "-mark").when(n["g3"]["others"] > 0, "-shared").otherwise("")
    words = F.when(new, F.concat(F.lit("new-"), before, kind)).otherwise(F.greatest(F.lit(-20), F.least(F.lit(20), odds)).cast("string"))
    judged = said.join(once.select("text_id", F.col("g1").alias("last")), "text_id").select("text_id", words.alias("words"))
    return parts.join(judged, "text_id", "left").select("doc_id", "source", "n_chars", "n_bytes", "text_id", "sign", F.coalesce("words", F.lit("none")).alias("words"))


#: Log odds that the estimate starts from for last words that the counts say nothing of.
NEW = {"new-on": 3.5, "new-end": 1.0, "new-unknown": 2.0, "new-on-shared": 2.0, "new-end-shared": -1.0, "new-unknown-shared": -1.0, "new-on-mark": 0.5, "new-end-mark": -0.5, "new-unknown-mark": 0.0, "none": 0.0}


def learn_evidence(cells: pd.DataFrame, base_rate: float, rounds: int = 25) -> tuple[pd.DataFrame, float]:
    """Log odds that each look of an ending and each class of last words bring, and the base rate, by EM without labels.

    `cells` counts distinct texts by sign, words and the censoring posterior of their length (null away from any limit).
    Texts are cut or whole; given that, sign and words are independent. The posterior of the length is the prior at a
    limit, elsewhere it is the base rate, which is estimated too: it starts from `base_rate` of all texts, none of which
    ends with a sentence. Looks of `CERTAIN` keep their class; known last words bring the ratio that was counted.
    """
    open_ = cells[~cells["sign"].isin(list(CERTAIN))].reset_index(drop=True)
    n = open_["n"].to_numpy(float)
    rate = min(0.5, base_rate * float(cells["n"].sum()) / max(1.0, float(n.sum())))
    at_limit = open_["prior"].notna().to_numpy()
    prior = open_["prior"].fillna(rate).to_numpy(float)
    signs, sign_at = np.unique(open_["sign"].to_numpy(str), return_inverse=True)
    words, word_at = np.unique(open_["words"].to_numpy(str), return_inverse=True)
    of_sign = np.array([STARTS.get(s, 0.0) for s in signs], dtype=float)
    counted = np.array([w not in NEW for w in words], dtype=bool)
    of_words = np.array([NEW[w] if w in NEW else int(w) / 2 for w in words], dtype=float)
    first = {"sign": of_sign.copy(), "words": of_words.copy()}
    score = lambda: 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + of_sign[sign_at] + of_words[word_at], -30, 30)))

    def ratio(at: np.ndarray, begin: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Log ratio of the shares of each class among cut and whole texts; one seen seldom keeps to where it started."""
        a, b = np.bincount(at, cut, len(begin)), np.bincount(at, n - cut, len(begin))
        lean = np.exp(begin / 2)
        a, b = a + 5 * lean / lean.sum(), b + 5 / lean / (1 / lean).sum()
        return np.log(a / a.sum()) - np.log(b / b.sum())

    for _ in range(rounds if len(open_) else 0):
        cut = score() * n
        of_sign = ratio(sign_at, first["sign"], cut)
        of_words = np.where(counted, of_words, ratio(word_at, first["words"], cut))
        if (~at_limit).any():
            rate = float(np.clip((score() * n)[~at_limit].sum() / max(1.0, n[~at_limit].sum()), 1e-4, 0.5))
            prior = np.where(at_limit, prior, rate)
    learned = open_.assign(odds=of_sign[sign_at] + of_words[word_at])
    return learned[["sign", "words", "odds"]].drop_duplicates(["sign", "words"]), rate


def _at_limits(rows: DataFrame) -> DataFrame:
    limits = censoring_limits(rows.select("source", "n_chars", "n_bytes", "text_id"))
    at = lambda unit, size: limits.where(F.col("unit") == unit).select("source", F.col("length").alias(size), F.col("posterior").alias(f"at_{unit}"))
    # limits are a few rows per source
    return rows.join(at("chars", "n_chars"), ["source", "n_chars"], "left").join(at("bytes", "n_bytes"), ["source", "n_bytes"], "left")


def truncated_documents(docs: DataFrame, base_rate: float = 0.02) -> DataFrame:
    """doc_id, source, n_chars, limit_length (null if none), prior, evidence, posterior, cut.

    The censoring posterior of a value's length is its prior; the ending's log odds, learned over all distinct texts,
    are added. `base_rate` is where the estimate of the prior away from any limit starts. A text that ends at the end of
    a sentence isn't cut inside one, whatever its length. Null and empty texts and null ids give no row. Repeated ids
    count once. Sources without a pile of equal lengths have no limits; a null source counts as one of its own.
    """
    both = cut_lineage(_at_limits(ending_classes(docs, base_rate)))
    at = F.greatest("at_chars", "at_bytes")
    # distinct texts by look, last words and limit: some thousand cells at most, whatever the number of texts
    step = F.round(F.log(at / (1 - at)) * 2) / 2
    cells = both.select("text_id", "sign", "words", (1 / (1 + F.exp(-step))).alias("prior")).distinct().groupBy("sign", "words", "prior").agg(F.count("*").alias("n")).toPandas()
    learned, rate = learn_evidence(cells, base_rate)
    certain = F.create_map(*[F.lit(x) for s, c in CERTAIN.items() for x in (s, 12.0 if c else -12.0)])
    weights = docs.sparkSession.createDataFrame([(str(r.sign), str(r.words), float(r.odds)) for r in learned.itertuples()], "sign string, words string, odds double")
    scored = both.join(F.broadcast(weights), ["sign", "words"], "left").withColumns({"evidence": F.coalesce(F.try_element_at(certain, F.col("sign")), "odds", F.lit(0.0)), "prior": F.coalesce(at, F.lit(rate))})
    logit = F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("evidence")
    limit = F.when(F.col("at_chars").isNotNull(), F.col("n_chars")).when(F.col("at_bytes").isNotNull(), F.col("n_bytes"))
    out = scored.select("doc_id", "source", "n_chars", limit.alias("limit_length"), "prior", "evidence", (1 / (1 + F.exp(-logit))).alias("posterior"))
    return out.withColumn("cut", F.col("posterior") > 0.5).dropDuplicates(["doc_id"])


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, those cut at a limit, and the rate."""
    cut = F.col("cut")
    return found.groupBy("source").agg(
        F.count("*").alias("n_texts"),
        F.count_if(cut).alias("n_cut"),
        F.count_if(cut & F.col("limit_length").isNotNull()).alias("n_at_limit"),
        F.round(F.avg(cut.cast("double")), 6).alias("cut_rate"),
    )
