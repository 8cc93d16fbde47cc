"""Template residue, filler and page messages in place of content.

Texts are cut into cues and lines; numbers, addresses and dates are masked, and equal messages are grouped by hash, over all documents and sources.
Of the distinct messages, wrong encodings are undone, slots are masked and what character recognition confuses is set aside; what is then equal is counted together.

A message that recurs widely (several times, in at least two documents and two sources) is residue if it is the text of untimed pages and hardly
ever dialogue, whatever its words, or if it names a part of a site or program and its state. Whether or not it recurs, it is residue if a rule for placeholders, filler,
open notes or page messages holds. Documents that hold such a message are found by its hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.session import materialise

BROADCAST_MESSAGES = 200_000
WIDE_TIMES = 3
PAGE_SHARE = 50  # one of so many occurrences of a message that pages make residue is on a page

FORMATTING = "i|b|u|s|em|strong|font|br|p|div|span|c|v|ruby|rt|lang|html|head|body|h[1-6]"
LATIN = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat"

_NAME = r"[\p{L}_][\p{L}\p{N}_.]*"
PLACEHOLDER = "|".join([
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"[$#]\{{\s*{_NAME}\s*\}}", rf"\{{\s*[\p{{L}}_][\p{{L}}\p{{N}}_.]{{3,}}\s*\}}", rf"%[\p{{L}}_][\p{{L}}\p{{N}}_.]{{2,}}%", rf"\$[\p{{L}}_][\p{{L}}\p{{N}}_.]{{2,}}\$",
    rf"__[\p{{L}}][\p{{L}}\p{{N}}.]*(?:_[\p{{L}}\p{{N}}.]+)*__", rf"@@\s*{_NAME}\s*@@", rf"\[\[\s*{_NAME}\s*\]\]", r"<%[^%>]*%>", r"\[insert [^\]]+\]", r"\[your [^\]]+\]",
    rf"<(?!/?(?:{FORMATTING})\b)[\p{{L}}_][\p{{L}}\p{{N}}_.]{{2,}}>", r"(?<![\d%])%\d?\$?[sd](?![\p{L}\d])",
    r"(?<![}\w])\{#\}(?!\{)",
])
_REPEATED = r"(\p{Lu}{2,})_[\p{Lu}_]*_?\1"  # XX_TITLE_XX: the only pattern that minds the case
_SLOTS = f"(?i:{PLACEHOLDER})|" + rf"(?<![\p{{L}}\p{{N}}_]){_REPEATED}(?![\p{{L}}\p{{N}}_])"
_REST = r"[^,!?]*$"  # to the end, without an address to someone or a second sentence of talk
FILLER = "|".join([
    r"^(?:x{2,}[ .!?-]*)+$", r"^(?:asdf(?:gh)?|jkl|qwertz?|qwerty)(?: (?:asdf(?:gh)?|jkl|qwertz?|qwerty))*$", r"^test(?:[ .]+test)+[ .!]*$", r"^lorem ipsum\b", rf"^(?:{LATIN})(?:[ ,.]+(?:{LATIN})){{3,}}[ .]*$",
    r"^dummy (?:subtitle|text|line)\b", rf"^(?:sample|placeholder|example|filler) (?:text|subtitle|line)\b{_REST}", r"^(?:type|enter|write|put) (?:your|the|dialogue|text|subtitle)\b[^,!?]*\b(?:here|speaker \w)\W*$", r"^(?:text|subtitle|dialogue|line) goes here\W*$", r"^dialogue line (?:one|two|three|#)",
    r"^\W*(?:texte?|texto|testo|tekst) (?:de |di |d')?(?:ejemplo|prueba|relleno|esempio|prova|exemple|factice|remplissage)\W*$", r"^\W*(?:beispiel|muster|blind|platzhalter|voorbeeld|vul)-?(?:text|tekst|untertitel)\W*$", r"^\W*пример текста\W*$",
])
_TRANSLATED = r"(?:not yet|to be|still to be) translated|untranslated(?: line)?|needs translation|noch (?:zu )?übersetzen|nicht übersetzt|à traduire|non traduit|por traducir|sin traducir|da tradurre|non tradotto|te vertalen|nog te vertalen|niet vertaald|нужен перевод|не переведено"
NOTE = "|".join([
    r"^\W*(?:todo|fixme)\s*[:!]", r"^\W*(?:todo|fixme|tbd|tba|tbc)\W*$", r"^fixme [^.?!]*$", rf"^\W*(?:translation missing|missing (?:line|translation|text)|{_TRANSLATED})\W*$",
    r"^\W*(?:translator|transcriber|editor|proofreader)s?(?: note)?\s*:.*\b(?:fill|check|translate|fix|insert|complete)\b",
])
_PAGE_NOT_FOUND = r"seite nicht gefunden|page introuvable|pagina non trovata|página no encontrada|страница не найдена|pagina niet gevonden|(?:page|file) not found"
#: looked for only in messages with a word that each of these needs: script, cookie or limit
MESSAGE_ANYWHERE = "|".join([
    r"\b(?:enable|activate|turn on|requires?|allow|need)\b[^.!?]*\b(?:javascript|cookies|scripts)\b", r"\b(?:javascript|cookies)\b[^.!?]*\b(?:enabled|required|allowed|disabled|blocked|turned off)\b",
    r"(?:activer|aktivieren|aktiviere|activa|activar|включите|attiva|attivare|schakel)[^.!?]*(?:javascript|cookies)", r"\bbrowser does not support (?:scripts|javascript)\b", r"\bdownload limit (?:reached|exceeded)\b",
])
_THING = r"(?:the|this) (?:subtitles?|file|page|link|url)"
MESSAGE = "|".join([
    r"^(?:http )?(?:error|fehler|erreur|errore|fout|ошибка) ?#(?!\w)", rf"^# ?[-:|]? ?(?:not found|forbidden|unauthorized|internal server error|bad gateway|service unavailable|{_PAGE_NOT_FOUND})\W*$",
    rf"^(?:not found|{_PAGE_NOT_FOUND}|bad gateway|gateway time-?out|internal server error)\W*(?:$|the (?:server|page|file|requested)\b)", rf"^service (?:temporarily )?unavailable\b",
    r"^(?:fatal error|parse error|warning|notice|uncaught \w+):.*\b(?:line #|undefined|cannot connect|failed to|database)", r"^traceback \(most recent call last\)", r"^exception in thread\b", r"^(?:caused by: |at )?(?:\w+\.)+\w+\(\w+\.(?:java|kt|scala):#\)", r"^(?:\w+\.){2,}\w*(?:exception|error)\b",
    r"^(?:access denied|zugriff verweigert|accès refusé|acceso denegado|accesso negato|toegang geweigerd|доступ запрещ[её]н)\.?(?:$| [^,!?]*$)",
    rf"^(?:your )?session has expired\b", rf"^(?:please )?(?:log|sign) ?in to (?:continue|view|download)\b{_REST}", r"^too many requests(?:\W*$| ?[-.:]? ?(?:please )?(?:try|slow|wait|retry)\b)", rf"^checking your browser\b{_REST}",
    rf"^the server (?:is down|is temporarily|is unavailable|could not|encountered|did not respond)\b(?:$|\W*$| [^,!?]*\b(?:maintenance|request|moment|time|error|load)\b)", rf"^{_THING}\b[^,!?]*\b(?:has been removed|no longer exists|does not exist|was deleted|is broken|is not available|could not be found)\b{_REST}",
    r"^dieser? (?:untertitel|datei|seite) (?:wurde|existiert|ist nicht)\b[^,!?]*$", r"^oops!? something went wrong\b[^,?]*$", r"^nothing here\. go back\b[^,!?]*$",
])
# words for the parts of a site or program, and for their states and what a visitor is told to do; a message that recurs widely has one of each
_PARTS = "|".join([
    "javascript|cookies?|browser|navigateur|navegador|captcha|https?|html|url|javascripts?|server|serveur|servidor|сервер[а-я]*|браузер[а-я]*|database|datenbank|base de datos",
    "session|sitzung|sesión|sessione|sessie|сессия|log-?in|account|konto|compte|cuenta|webmaster|administrator|download|upload|website|webseite|site|sitio|sito|сайт[а-я]*",
    "page|seite|página|pagina|страниц[а-я]*|file|datei|fichier|archivo|bestand|файл[а-я]*|subtitles?|untertitel|sous-titres?|subtítulos?|sottotitoli|ondertitels?|субтитр[а-я]*",
    "requests?|anfragen?|requête|solicitud|richiesta|verzoek|error|fehler|erreur|errore|fout|ошибка|access|zugriff|accès|acceso|accesso|toegang|доступ|scripts?|app|content|inhalt|contenu|contenido|inhoud|human|robot|sie sich",
])
_STATES = "|".join([
    "not found|nicht gefunden|introuvable|non trovat[ao]|no encontrad[ao]|niet gevonden|не найден[а-я]*|expired|abgelaufen|expirée?|caducad[ao]|scadut[ao]|verlopen|denied|verweigert|refusée?|denegado|negato|geweigerd",
    "unavailable|nicht verfügbar|indisponible|no disponible|non disponibile|maintenance|wartung|mantenimiento|manutenzione|onderhoud|undefined|cannot connect|permissions?|timed out",
    "enabled?|activate|aktivieren|activer|activar?|attivare?|включите|disabled|switched off|required|allowed|try again|reload|refresh|sign(?:ed)? in|logged in|log in|melden|anmelden|connectez|inicia|accedi|войдите",
    "removed|gelöscht|deleted|no longer exists?|broken|verify|fortzufahren|continuer|continuar|continuare|doorgaan|продолжить|needs?|limit",
])
_TALK = r"\b(?:i|i'm|me|my|he|she|him|her|his|they|them|ich|mein|er|je|moi|mon|yo|mi|io|ik|mijn)\b"

_CUE_MARK = r"(?m)^[ \t\uFEFF]*(?:\d+[ \t]*|[\d:,. \t]+-->[^\n]*|WEBVTT.*)$"


_CONFUSED = [("rn", "m"), ("ol", "d"), ("ll", "h"), ("vv", "w")]


def _fold(text: Column | str):
    """Sets aside what character recognition confuses: the same for messages and for the words of the rules."""
    if isinstance(text, str):
        out = text.lower().translate(str.maketrans("01i|ce", "ollloo"))
        for a, b in _CONFUSED:
            out = out.replace(a, b)
        return out
    out = F.translate(F.lower(text), "01i|ce", "ollloo")
    for a, b in _CONFUSED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _folded(pattern: str) -> str:
    """A pattern whose words are folded; escapes and classes stay."""
    return re.sub(r"\\.|\[[^\]]*\]|[^\W\d_]+", lambda m: m[0] if m[0][0] in "\\[" else _fold(m[0]), pattern)


# the characters that cp1252 or Latin-1 make of the bytes of a UTF-8 sequence; a lost one counts as 0x81, which cp1252 has no character for
_BYTES = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)} | {"\ufffd": 0x81}
_LEAD = "".join(chr(b) for b in range(0xC2, 0xF5))
_MISREAD = f"[{_LEAD}][{''.join(c for c, b in _BYTES.items() if b < 0xC0)}]"
_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def repaired(text: str) -> str:
    """The text with what was UTF-8 and read as cp1252 or Latin-1, once or twice, read again."""

    def again(run: re.Match) -> str:
        raw = [_BYTES.get(c) for c in run[0].replace("Ã\ufffd", "Ã\x90")]  # of letters that start with a lost byte Cyrillic ones are the most
        if None in raw:
            return run[0]
        made = bytes(raw).decode("utf-8", "replace")
        return made if 2 * made.count("\ufffd") < len(made) else run[0]

    for _ in range(2):
        text = _RUN.sub(again, text)
    return re.sub(r"[\s\u00a0]+", " ", text).strip()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the repaired message to rows whose first column is one; only what looks misread is touched."""
    for batch in batches:
        own = batch.column(0)
        odd = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(own, _MISREAD), False)).to_pylist()
        if odd:
            texts = own.to_pylist()
            for k in odd:
                texts[k] = repaired(texts[k])
            own = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "plain"])


def messages(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, page, message): every cue and every line of each text, masked; page tells that the text has no cues."""
    text = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    cues = F.split(F.regexp_replace(text, _CUE_MARK, "\u0001"), r"\u0001|\n[ \t]*\n")
    trimmed = F.filter(F.transform(cues, lambda c: F.trim(c, F.lit(" \t\n\ufeff"))), lambda c: c != "")
    parts = F.flatten(F.transform(trimmed, lambda c: F.when(F.contains(c, F.lit("\n")), F.concat(F.array(c), F.split(c, "\n"))).otherwise(F.array(c))))
    # what is the same for all messages of a text is computed before they are unnested, else it would be computed for each
    whole = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (~F.contains(F.col(text_col), F.lit("-->"))).alias("page"), F.array_distinct(parts).alias("parts"))
    return masked(whole.select("doc_id", "source", "page", F.explode("parts").alias("message")))


def masked(df: DataFrame) -> DataFrame:
    """The messages of df with formatting aside, addresses as @, numbers, dates and times as #, blanks as one. Each pattern runs only on messages with a
    character it needs, and each step is a projection of its own, so that none is computed again for the next."""
    m = F.col("message")
    has = lambda *marks: reduce(lambda x, y: x | y, [F.contains(m, F.lit(k)) for k in marks])
    steps = [
        (has("<", "{"), F.regexp_replace(m, rf"(?i)</?(?:{FORMATTING})(?:\b[^>]{{0,80}})?/?>|\{{\\[^}}]*\}}|\{{\w:\w+\}}", " ")),
        (has("@", "://", "www."), F.regexp_replace(m, r"(?i)\b(?:https?://\S+|[\w.+-]+@[\w-]+\.[\w.-]+|www\.\S+)", "@")),
        (m.rlike("[0-9]"), F.regexp_replace(m, r"(?<![\p{L}_%\d])\d+(?:[.,:/-]\d+)*(?![\p{L}_])", "#")),
        (has("  ", "\n", "\t", "\u00a0"), F.regexp_replace(m, r"(?:\s|(?<![\u00c2-\u00f4])\u00a0)+", " ")),
        (has("- ", " -", "– ", " –"), F.regexp_replace(F.trim(m), r"^[-–] | [-–]$", " ")),
    ]
    for test, made in steps:
        df = df.withColumn("message", F.when(test, made).otherwise(m))
    return df.withColumn("message", F.trim(m))


def _with_rule(df: DataFrame) -> DataFrame:
    """Adds rule: placeholder, filler, note, message or null, of the column plain, by rules that need no recurrence."""
    low, plain = F.col("folded"), F.col("plain")
    anywhere = reduce(lambda x, y: x | y, [F.contains(low, F.lit(_fold(w))) for w in ("script", "cookie", "limit")])
    slots = F.col("slotted") != plain
    kind = F.when(slots, "placeholder").when(low.rlike(_folded(FILLER)), "filler").when(low.rlike(_folded(NOTE)), "note").when(low.rlike(_folded(MESSAGE)) | (anywhere & low.rlike(_folded(MESSAGE_ANYWHERE))), "message")
    slotted = F.when(plain.rlike(r"[{%$_@\[<]"), F.regexp_replace(plain, _SLOTS, "\u25a1")).otherwise(plain)
    return df.withColumn("folded", _fold(plain)).withColumn("slotted", slotted).withColumn("rule", kind)


def _site_message(message: Column) -> Column:
    """Whether a message in lower case names a part of a site or program and a state, and isn't somebody's talk about it."""
    low = message
    word = lambda p: rf"(?U)(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])"
    return low.rlike(word(_STATES)) & low.rlike(word(_PARTS)) & ~low.rlike(_TALK) & ~F.contains(low, F.lit("@"))


def _with_group(df: DataFrame) -> DataFrame:
    """Adds g, the hash of what is counted together: slots masked, other than ASCII set aside where most is ASCII, confused characters folded, no marks at the ends."""
    low = F.col("low")
    df = df.withColumn("low", F.when(F.col("slotted") == F.col("plain"), F.col("folded")).otherwise(_fold(F.col("slotted")))).withColumn("plainest", F.when(F.octet_length(low) != F.length(low), F.regexp_replace(low, r"[^\x00-\x7f]+", "?")).otherwise(low))
    odd = (F.octet_length(low) != F.length(low)) & (F.length(F.regexp_replace("plainest", "[^a-z]", "")) * 2 >= F.length(low))
    return df.withColumn("g", F.xxhash64(F.trim(F.when(odd, F.col("plainest")).otherwise(low), F.lit(" .*-–")))).drop("low", "plainest")


def residue_messages(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The places (doc_id, source, page, message, h) of all messages, and the classified ones (h, rule, wide)."""
    placed = materialise(messages(df, id_col, text_col, source_col).withColumn("h", F.xxhash64(F.lower("message"))), "residue-places").where("message <> ''")
    source, doc = F.xxhash64(F.coalesce("source", F.lit("\0"))), F.xxhash64("doc_id")  # a null source is one of its own
    span = [("d0", F.min, doc), ("d1", F.max, doc), ("s0", F.min, source), ("s1", F.max, source)]
    distinct = placed.groupBy("message", "h").agg(F.count("*").alias("n"), F.sum(F.col("page").cast("long")).alias("pages"), *[f(c).alias(k) for k, f, c in span])
    plain = distinct.mapInArrow(_repair, "message string, h long, n long, pages long, d0 long, d1 long, s0 long, s1 long, plain string")
    words = ~F.contains("plain", F.lit("@")) & (F.length(F.regexp_replace("plain", r"[^\p{L}]", "")) >= 4)
    graded = _with_group(_with_rule(plain)).withColumn("site", _site_message(F.lower("plain"))).withColumn("words", F.when(F.col("pages") > 0, words).otherwise(True))
    graded = materialise(graded.select("h", "g", "n", "pages", "d0", "d1", "s0", "s1", "rule", "site", "words"), "residue-graded")

    # only groups with a member that may be residue are counted
    some = materialise(graded.where("rule is not null or site or pages > 0").select("g").distinct(), "residue-candidates")
    own = graded.join(_bounded(some), "g", "left_semi")
    sums = own.groupBy("g").agg(F.sum("n").alias("times"), F.sum("pages").alias("on_pages"), F.max("rule").alias("own"), F.max("site").alias("any_site"), F.min("words").alias("all_words"), *[f(k).alias(k) for k, f, _ in span])
    wide = (F.col("times") >= WIDE_TIMES) & (F.col("d0") != F.col("d1")) & (F.col("s0") != F.col("s1"))
    page = (F.col("on_pages") > 0) & (F.col("on_pages") * PAGE_SHARE >= F.col("times")) & F.col("all_words")
    why = F.coalesce("own", F.when(F.col("wide") & page, "page"), F.when(F.col("wide") & F.col("any_site"), "site"))
    kept = materialise(sums.withColumn("wide", wide).withColumn("why", why).where("why is not null").select("g", "wide", "why"), "residue-groups")
    found = graded.select("h", "g", "rule").join(_bounded(kept), "g").select("h", F.coalesce("rule", "why").alias("rule"), "wide")
    return placed, materialise(found.groupBy("h").agg(F.min("rule").alias("rule"), F.max("wide").alias("wide")), "residue-found")


def _bounded(df: DataFrame) -> DataFrame:
    """A written table of a few fixed columns, broadcast where it has at most BROADCAST_MESSAGES rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_MESSAGES else df


def residue_documents(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id): the documents that hold residue.

    Null and empty texts hold none; very long texts are read whole; a null source is a source of its own; documents with the same text are
    all found. An empty table gives no row. Other columns are ignored, whatever their names."""
    placed, found = residue_messages(df, id_col, text_col, source_col)
    return placed.select("doc_id", "h").join(_bounded(found.select("h")), "h", "left_semi").select("doc_id").distinct()


def clean_documents(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """df without the documents that hold residue."""
    return df.join(residue_documents(df, id_col, text_col, source_col).withColumnRenamed("doc_id", id_col), id_col, "left_anti")


def residue_report(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(message, rule, wide, documents, sources) of each classified message; wide: it recurs widely."""
    placed, found = residue_messages(df, id_col, text_col, source_col)
    rows = placed.select("h", "message", "doc_id", "source").join(_bounded(found), "h")
    return rows.groupBy("h", "rule", "wide").agg(F.min("message").alias("message"), F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("sources")).drop("h")
