"""Pieces of DuckDB SQL that the plans' oracles share. DuckDB's patterns have no look-around."""

from __future__ import annotations

from scriptora.functions.text import CAP


def subs(expr: str, *pairs: tuple[str, str]) -> str:
    for pattern, to in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


def clean(expr: str) -> str:
    """Text cleaning without the spaced capitals."""
    return subs(
        f"nfc_normalize(coalesce({expr}, ''))",
        ("[\\x{00AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]", ""),
        ("<[^>]+>", ""),
        ("[\\s\\x{00A0}]+", " "),
        ("^ +| +$", ""),
        (rf"(\b[0-9]+)({CAP}[a-z])", r"\1 \2"),
        (r"(\b[0-9]+) +\.", r"\1."),
        (" +([,;:!?])", r"\1"),
        (r""" +([."'')\]}])""", r"\1"),
        (r"""([(\["'']) +""", r"\1"),
    )


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def paragraphs(of: str = "documents") -> str:
    """Paragraphs of a table like documents: cleaned lines with a text, numbered in a document from 1."""
    return f"""
lines AS (SELECT doc_id, lang, source, generate_subscripts(l, 1) AS ln, unnest(l) AS line
          FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM {of})),
paragraphs AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS paragraph_id, text,
                      len(regexp_extract_all(text, '\\S+')) AS word_count
               FROM (SELECT *, {clean('line')} AS text FROM lines) WHERE text <> '')"""


PARAGRAPHS = paragraphs()
