"""Quality rules, lines first: lines that break a punctuation, navigation or boilerplate rule go, and a document that
loses too much of its text with them is rejected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm._common import lean, shipped_by_value

BLANK = " \t\n\x0b\x0c\r"
#: Symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Labels of menus in the languages.
_LABELS = (
    r"home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content"
    r"|startseite|menü|anmelden|abmelden|registrieren|suche|weiter|zurück|nach oben|zum inhalt"
    r"|accueil|connexion|se connecter|s'inscrire|rechercher|suivant|précédent|haut de page|aller au contenu"
    r"|inicio|menú|iniciar sesión|registrarse|buscar|siguiente|anterior|volver arriba|ir al contenido"
)
#: A line of navigation has labels only; a sentence that begins with one of these words is none.
NAVIGATION = rf"(?i)^\PL*({_LABELS})(\PL+({_LABELS}))*\PL*$"
#: What stands between the labels of a menu.
SEPARATORS = "|»›·•"
#: Phrases of boilerplate in the languages; a word alone, like the one for a biscuit, is none.
_NOTICES = (
    r"(we|site|website|page) uses? cookies|accept (all )?cookies|cookie (policy|settings|notice|preferences)|privacy policy|terms of (use|service)|all rights reserved"
    r"|(enable|activate|requires) javascript|lorem ipsum|subscribe (now|today)"
    r"|verwende[nt] cookies|alle cookies|cookie-(richtlinie|einstellungen)|datenschutz|impressum|nutzungsbedingungen|alle rechte vorbehalten|jetzt abonnieren|javascript aktivieren"
    r"|utilis(e|ons) des cookies|accepter (tous )?les cookies|politique de confidentialité|mentions légales|conditions d'utilisation|tous droits réservés|abonnez-vous|activer javascript"
    r"|(utiliza|utilizamos|usamos) cookies|aceptar (todas )?las cookies|política de privacidad|aviso legal|condiciones de uso|todos los derechos reservados|suscríbete|activar javascript"
)
#: Calls that are boilerplate at the end of a line, but may begin a sentence.
_CALLS = r"click here|read more|newsletter|share (this|on \pL+)|hier klicken|weiterlesen|cliquez ici|lire la suite|haga clic( aquí)?|leer más"
BOILERPLATE = rf"(?i){_NOTICES}|({_CALLS})\PL*$"
#: What may end a sentence: the marks that Unicode has for that in any script, colons, commas, quotes and closing brackets.
ENDINGS = "".join(c for c in map(chr, range(0x11FFF)) if regex.match(r"\p{Sentence_Terminal}|\p{Pe}|\p{Pf}", c)) + "…:;,\"'"
#: A line goes on in the next one if that begins with a small letter.
GOES_ON = r"^\p{Ll}"


def line_fails(line: str, n_words: int, long_line: int = 12, following: str = "") -> str | None:
    """The rule that a line with n_words words breaks, if any: symbols, shouting, ending (a line as long as a sentence
    has to end like one, unless the following line goes on with it), navigation, boilerplate."""
    body = line.strip(BLANK)
    if sum(map(body.count, SYMBOLS)) * 10 > 3 * len(body):
        return "symbols"
    if n_words >= 5 and body.count("!") * 2 > n_words and body == body.upper():
        return "shouting"
    if n_words >= long_line and body[-1] not in ENDINGS and not regex.match(GOES_ON, following.strip(BLANK)):
        return "ending"
    if sum(map(body.count, SEPARATORS)) * 4 >= n_words + 4 or n_words <= 20 and regex.search(NAVIGATION, body):
        return "navigation"
    if n_words <= 20 and regex.search(BOILERPLATE, body):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of `size` words found at least twice in the text. Hashes only rule out texts in which
    all windows differ; windows whose hashes meet are compared word by word."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.uint64, count=len(words))
    if len(index) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    suspects = np.zeros(n, dtype=bool)
    suspects[order[1:][same]] = suspects[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    starts = np.flatnonzero(suspects).tolist()
    for s in starts:
        key = tuple(words[s : s + size])
        seen[key] = seen.get(key, 0) + 1
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for s in starts:
        if seen[tuple(words[s : s + size])] > 1:
            marks[s] += 1
            marks[s + size] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def measure(text: str | None, max_lost: float = 0.5) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_removed_lines and
    the text of the lines that stay. A null text has no words and fails."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, BLANK))
    seen: set[str] = set()
    dup = removed = n_lines = lost = 0
    stay = []
    lines = text.split("\n")
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        chars = len(line) - sum(map(line.count, BLANK))
        if not chars:
            stay.append(line)
            continue
        n_lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line, len(line.encode("utf-8", "surrogatepass").split()), following=following):
            removed += 1
            lost += chars
        else:
            stay.append(line)
    repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and lost <= max_lost * word_chars
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, kept, n_lines, removed, "\n".join(stay)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long"


def clean_lines(docs: DataFrame, max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """doc_id, the measures of each whole text, and cleaned_text, the lines that stay.

    One row in gives one row out, whatever is null, empty or repeated: a null or empty text has no words and fails, a
    null id is passed on, an empty table gives no rows; other columns aren't looked at.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in FIELDS.split(", ")]

    def rows(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            found = [measure(t.as_py(), max_lost) for t in b.column(1)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            last = [pa.array([f[-1] for f in found], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *last], names=["doc_id", *names, *["cleaned_text"] * with_text])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(rows), f"doc_id {doc_id}, {FIELDS}" + ", cleaned_text string" * with_text)


def quality_report(docs: DataFrame) -> DataFrame:
    """The measures without the cleaned text."""
    return clean_lines(docs, with_text=False)


shipped_by_value(__name__)
