"""Evaluation metrics as aggregate Columns over labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(top: Column, bottom: Column) -> Column:
    return F.try_divide(F.count_if(top), F.count_if(bottom))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def precision(y: Column, p: Column) -> Column:
    return _rate((y == 1) & (p == 1), p == 1)


def recall(y: Column, p: Column) -> Column:
    return _rate((y == 1) & (p == 1), y == 1)


def specificity(y: Column, p: Column) -> Column:
    return _rate((y == 0) & (p == 0), y == 0)


def f1(y: Column, p: Column) -> Column:
    return F.try_divide(2 * F.count_if((y == 1) & (p == 1)), F.count_if(y == 1) + F.count_if(p == 1))


def matthews(y: Column, p: Column) -> Column:
    tp, tn, fp, fn = (F.count_if((y == a) & (p == b)).cast("double") for a, b in ((1, 1), (0, 0), (0, 1), (1, 0)))
    return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(y - p, y)))


def r2(y: Column, p: Column) -> Column:
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.regr_syy(y, y))


def log_loss(y: Column, q: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(q, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def brier(y: Column, q: Column) -> Column:
    return F.avg((q - y) * (q - y))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(y, p).agg(F.count("*").alias("n"))


def roc_auc(df: DataFrame, y: str, q: str) -> DataFrame:
    """Mann-Whitney form with ties at half: scores are counted first, so the running sum is over distinct scores."""
    by = df.groupBy(q).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    w = Window.orderBy(q).rowsBetween(Window.unboundedPreceding, -1)
    run = by.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return run.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def hinge_loss(y: Column, score: Column) -> Column:
    """y is 0 or 1."""
    return F.avg(F.greatest(1 - (2 * y - 1) * score, F.lit(0.0)))


def squared_hinge_loss(y: Column, score: Column) -> Column:
    m = F.greatest(1 - (2 * y - 1) * score, F.lit(0.0))
    return F.avg(m * m)


def poisson_deviance(y: Column, p: Column) -> Column:
    return 2 * F.avg(F.when(y > 0, y * F.ln(y / p)).otherwise(0.0) - (y - p))


def gamma_deviance(y: Column, p: Column) -> Column:
    return 2 * F.avg(F.ln(p / y) + y / p - 1)


def tweedie_deviance(y: Column, p: Column, power: float = 1.5) -> Column:
    k = power
    return 2 * F.avg(F.pow(F.greatest(y, F.lit(0.0)), F.lit(2 - k)) / ((1 - k) * (2 - k)) - y * F.pow(p, F.lit(1 - k)) / (1 - k) + F.pow(p, F.lit(2 - k)) / (2 - k))


def concordance_correlation(y: Column, p: Column) -> Column:
    d = F.avg(y) - F.avg(p)
    return F.try_divide(2 * F.covar_pop(y, p), F.var_pop(y) + F.var_pop(p) + d * d)


def kling_gupta_efficiency(y: Column, p: Column) -> Column:
    a, b = F.corr(y, p) - 1, F.try_divide(F.stddev_pop(p), F.stddev_pop(y)) - 1
    c = F.try_divide(F.avg(p), F.avg(y)) - 1
    return 1 - F.sqrt(a * a + b * b + c * c)


nash_sutcliffe_efficiency = r2


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds; rows where it is null don't count."""
    return F.avg(condition.cast("double"))


def _word(words: str) -> str:
    """The words as a pattern, in either case, between characters that aren't ASCII letters, digits or underscores."""
    return rf"(?i)(^|[^a-zA-Z0-9_])({words})($|[^a-zA-Z0-9_])"


#: What a text must hold to count in the rate of that name.
TEXT_RATES = {
    "email_rate": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_rate": r"\+?[0-9][0-9() .-]{6,}[0-9]",
    "ssn_like_rate": _word(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "credit_card_like_rate": _word(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    "heading_rate": r"(?m)^#{1,6} ",
    "bullet_list_rate": r"(?m)^\s*[-*] ",
    "numbered_list_rate": r"(?m)^\s*[0-9]+\. ",
    "markdown_link_rate": r"\[[^\]]+\]\([^)]+\)",
    "table_rate": r"(?m)^\|.*\|$",
    "code_block_present_rate": r"```",
    "question_rate": r"\?\s*$",
    "exclamation_rate": r"!\s*$",
    "hedge_rate": _word(r"maybe|perhaps|possibly|might|could be|i think|i believe|not sure|it seems|probably"),
    "first_person_rate": _word(r"i|i'm|i am|my|me|we|our"),
    "politeness_rate": _word(r"please|thank you|thanks|sorry|apologize|you're welcome"),
    "refusal_rate": _word(r"i can't|i cannot|i'm unable|i am unable"),
    "private_key_rate": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "data_uri_rate": r"data:[a-z]+/[a-z0-9.+-]+;base64,",
    "unsafe_html_rate": r"(?i)<script|javascript:|onerror=",
    "sql_injection_rate": r"(?i)('\s*or\s+'?1'?\s*=\s*'?1|union\s+select|drop\s+table)",
    "cjk_rate": r"[\u4e00-\u9fff]",
    "cyrillic_rate": r"[\u0400-\u04ff]",
    "arabic_rate": r"[\u0600-\u06ff]",
    "boxed_answer_rate": r"\\boxed\{",
}


def text_rate(name: str, text: Column) -> Column:
    return rate(text.rlike(TEXT_RATES[name]))


# Means over pairs of vectors, and over vectors.


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, v: t + v)


def _norm(x: Column) -> Column:
    return F.sqrt(_dot(x, x))


def mean_dot_product(x: Column, y: Column) -> Column:
    return F.avg(_dot(x, y))


def cosine(x: Column, y: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(_dot(x, y), _norm(x) * _norm(y))


def mean_cosine_similarity(x: Column, y: Column) -> Column:
    return F.avg(cosine(x, y))


def mean_cosine_distance(x: Column, y: Column) -> Column:
    return F.avg(1 - cosine(x, y))


def mean_angular_distance(x: Column, y: Column) -> Column:
    """The angle as a part of a half turn."""
    return F.avg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(x, y)))) / F.pi())


def _differences(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))


def mean_euclidean_distance(x: Column, y: Column) -> Column:
    return F.avg(_norm(_differences(x, y)))


def mean_manhattan_distance(x: Column, y: Column) -> Column:
    return F.avg(F.aggregate(_differences(x, y), F.lit(0.0), lambda t, v: t + F.abs(v)))


def mean_hamming_distance(x: Column, y: Column) -> Column:
    """The mean number of components that differ."""
    return F.avg(F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda v: v)))


def mean_embedding_norm(x: Column) -> Column:
    return F.avg(_norm(x))


def unit_norm_rate(x: Column, within: float = 1e-3) -> Column:
    return rate(F.abs(_norm(x) - 1) <= within)


def zero_vector_rate(x: Column) -> Column:
    return rate(_norm(x) == 0)


# Rates over generated texts.


def mean_ratio(top: Column, bottom: Column) -> Column:
    """The mean of row-wise ratios; rows with a zero or null bottom don't count."""
    return F.avg(F.try_divide(top, bottom))


def distinct_token_ratio(text: Column) -> Column:
    """The mean share of distinct words among a text's words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.avg(F.try_divide(F.size(F.array_distinct(words)), F.size(words)))


def empty_generation_rate(text: Column) -> Column:
    """The share of texts that are null or hold nothing but white space."""
    return rate(F.coalesce(~text.rlike(r"\S"), F.lit(True)))


def truncation_rate(text: Column) -> Column:
    """The share of texts whose last character, white space aside, doesn't end a sentence."""
    return rate(~text.rlike(r"[.!?\"')\]]\s*$"))


def contains_any_rate(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(text), F.lit(p.lower()))
    return rate(found)


def repeated_line_rate(text: Column) -> Column:
    """The share of texts in which a line that isn't blank stands twice."""
    lines = F.filter(F.split(text, "\n"), lambda w: F.trim(w) != "")
    return rate(F.size(lines) > F.size(F.array_distinct(lines)))


def mean_output_tokens(text: Column) -> Column:
    """The mean number of words."""
    return F.avg(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def latin_only_rate(text: Column) -> Column:
    """The share of texts without a character beyond Latin Extended-B."""
    return rate(~text.rlike(r"[^\x{0000}-\x{024f}]"))
