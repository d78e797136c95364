"""Document quality: seven signals, a weighted score and a route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions.text import count_of, words

_LATIN = "Apostolica|Dei|Dominus|Ecclesia|Magisterium|Verbum"
_WIDER = _LATIN + "|" + "|".join(
    sorted(
        """absolution apostolic beatitude catechism communion diocese encyclical eucharist evangelization incarnation liturgy
        magisterial ordination parish pontiff pontifical redemption resurrection sacrament salvation""".split()
    )
)
_FIRST = "".join(sorted({w[0].lower() for w in _WIDER.split("|")}))
#: A line end as Python has them; one class, as all but few characters fail it.
_LINE_END = r"[\n\r\x0b\f\x1c\x1d\x1e\x85[[^\x00-\xff]&&[\u2028\u2029]]](?:(?<=\r)\n)?+"
#: A character beyond tab, line ends, printable ASCII and the Latin blocks.
GARBLE = r"[[^ -~]&&[^\t\n\r\u00A0-\u02AF]]"


def signals(text: Column, garble: str = GARBLE) -> Column:
    """The seven signals, each 0 to 1; those of the worst text where it is null or empty."""
    c = F.coalesce(text, F.lit(""))
    n = F.length(c)
    lines = F.transform(F.filter(F.split(c, _LINE_END), lambda x: x.rlike(r"(?U)\S")), F.length)

    def rest(lines: Column) -> Column:
        k = F.size(lines)
        mean = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x) / k
        std = F.sqrt(F.aggregate(lines, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k)
        return F.struct(
            F.when(k > 0, F.least(F.lit(1.0), std / 120.0)).otherwise(0.2).alias("std"),
            F.when(k > 0, F.size(F.filter(lines, lambda x: x < 40)) / k).otherwise(0.0).alias("short"),
        )

    by_line = F.get(F.transform(F.array(lines), rest), F.lit(0))
    w = F.get(F.transform(F.array(words(F.lower(c))), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)), F.lit(0))
    garbled = F.least(F.lit(1.0), count_of(c, garble) / F.greatest(n, F.lit(1)))
    hits = F.regexp_count(c, F.lit(rf"(?=[ADEMV])\b(?:{_LATIN})\b"))
    wider = F.regexp_count(c, F.lit(rf"(?i)(?=[{_FIRST}])\b(?:{_WIDER})\b"))
    names = ("garble_rate", "mean_conf", "line_len_std_norm", "lang_prob", "lang_prob_v2", "lexical_density", "short_line_ratio")
    some = F.struct(
        garbled.alias(names[0]),
        (F.greatest(F.lit(0.0), 1.0 - garbled) * F.when(n > 2000, 1.0).otherwise(0.8)).alias(names[1]),
        by_line["std"].alias(names[2]),
        F.least(F.lit(1.0), 0.5 + 0.05 * hits).alias(names[3]),
        F.least(F.lit(1.0), 0.3 + 0.03 * wider).alias(names[4]),
        w.alias(names[5]),
        by_line["short"].alias(names[6]),
    )
    none = F.struct(*[F.lit(1.0 if x in (names[0], names[2]) else 0.0).alias(x) for x in names])
    return F.when(c == "", none).otherwise(some)


def score(s: Column) -> Column:
    """Cleanliness .4, confidence .3, even lines .1, language .2; NaN and infinities are 0; within 0 and 1."""
    v = 0.40 * (1 - s["garble_rate"]) + 0.30 * s["mean_conf"] + 0.10 * (1 - s["line_len_std_norm"]) + 0.20 * s["lang_prob"]
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def route(score: Column) -> Column:
    return F.when(score >= 0.80, "A").when(score >= 0.55, "B").otherwise("C")
