"""SQL for those text queries that it can say: reading a text as folded words, and what follows from counts of documents.

Tiling across foreign lines, tokens and retrieval have none; tests hold them against brute force and invariants instead.
"""

from __future__ import annotations

from tidemark.llm import words


def _replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _literal(pattern: str) -> str:
    return pattern.replace("'", "''")


def _speech(x: str) -> str:
    """The text without numbers, times, tags, sounds and labels; lookarounds become groups that are put back."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = _replaced(x, "(?m)" + _literal(words._TIMES.pattern), "")
    x = _replaced(x, _literal(words._NUMBER_FIRST.pattern), "\\1")
    x = _replaced(x, "(?i)" + _literal(words._BREAK_TAG.pattern), " ")
    x = _replaced(x, _literal(words._TAG.pattern), "")
    x = _replaced(x, "(?m)" + _literal(words._SOUND.pattern), " ")
    return _replaced(x, "(?m)" + _literal(words._LABEL.pattern.replace("(?=\\s)", "(\\s)")), "\\1\\2")


def _folded(x: str) -> str:
    """Folded words of a text, as a list."""
    spaces = words._SPACE.pattern.split(")", 1)[1]
    x = _replaced(x, f"(^|[\\x00-\\x7F]){spaces}", "\\1 ")
    x = _replaced(x, "[^\\x00-\\x7F]", "")
    for _ in range(2):
        x = _replaced(x, "([a-zA-Z])[''`?]([a-zA-Z])", "\\1\\2")
    x = f"lower({x})"
    for written, read in words.CONFUSED.items():
        x = f"replace({x}, '{written}', '{read}')"
    return f"regexp_extract_all({x}, '[a-z0-9]+')"


_WINDOWS = "SELECT id, hash(w[i : i + 15]) AS h, w[i : i + 15] AS words FROM (SELECT id, w, unnest(range(1, len(w) - 14)) AS i FROM {0} WHERE len(w) >= 16)"
#: Sixteen folded words in a row, for items in Latin letters; those in others are read as they are and compared apart.
P6_EXACT = f"""
WITH d AS (SELECT doc_id AS id, {_folded(_speech("text"))} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS id, {_folded(_speech("passage"))} AS w FROM eval_items WHERE passage IS NOT NULL AND 2 * length(regexp_replace(passage, '[^a-zA-Z]', '', 'g')) >= length(regexp_replace(passage, '[^\\pL]', '', 'g')))
SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM ({_WINDOWS.format("d")}) x JOIN ({_WINDOWS.format("e")}) y ON x.h = y.h AND x.words = y.words"""

#: What the mix must come to: the target among the sources that have documents, and none for the others.
P7_GOALS = """
WITH have AS (SELECT lower(trim(source)) AS source_name, count(*) AS documents FROM documents WHERE length(text) > 0 GROUP BY 1),
t AS (SELECT lower(trim(mix_targets.source_name)) AS source_name, target_share, max_repeats, coalesce(documents, 0) AS documents FROM mix_targets LEFT JOIN have ON lower(trim(mix_targets.source_name)) = have.source_name)
SELECT source_name, documents, CASE WHEN documents > 0 THEN round(target_share / (SELECT sum(target_share) FROM t WHERE documents > 0), 2) ELSE 0 END::DOUBLE AS share, documents = 0 AS falls_short, true AS within_repeats FROM t"""

ORACLES: dict[str, str] = {"p6_exact": P6_EXACT, "p7_goals": P7_GOALS}
