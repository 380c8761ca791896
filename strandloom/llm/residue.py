"""Template residue, filler and error-page text in documents.

A text is folded: entities resolved, compatibility forms joined, blanks and signs
dropped, accents and case removed and look-alikes of bad scans (0/o, 1/l, rn/m) made
equal. One multi-pattern automaton holds the vocabulary of such material in several
languages, by role: what a message is about (scripts, a page, a service), what it says
(is required, not found, denied), what it asks for; words that order a text to be
filled in, the parts of a patent, and places; words of reports and quotations. Longer words are also
held with any two neighbouring letters exchanged. Words that follow one another closely make a phrase, and a phrase is
a message if its roles go together: subject and state, code and state, order and part.

Use is told from mention by the clause. A message in use begins a line or sentence and
covers most of it; one that is described stands inside a clause, between quotation
marks, behind a colon that a word such as "message" leads to, under a condition, or
beside a verb of report or a reference numeral, and counts nothing. Placeholders are
found by their delimiters, filler by runs of its words; these count anywhere but in a quotation.

What remains is residue. Weaker phrases, of words that ordinary texts hold too, count only when
together they cover most of the document (``page_share``): a page made up of them. A
document is excluded when the share of its letters that is residue exceeds ``least_share``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary of messages and templates by role, "|" between entries.
SCRIPT = "脚本|スクリプト|javascript|java script|scripts|scripting|skripte|skripts|script support|js enabled|enable js|without js|cookies|react app"
NEED = """enable|enabled|enabling|disabled|turn on|turned on|turned off|turn scripts on|switched off|switch on|requires|required|require|needs|need to|must be active|not supported|does not support|doesn't support|not support|blocked|blocking|doesn't work|does not work|activate|activated|allow
activer|activez|l'activation|désactivé|désactivés|nécessite|nécessaire|requis|bloque|bloqué|ne prend pas en charge|autoriser
aktivieren|aktiviert|schalten sie|deaktiviert|einschalten|ausgeschaltet|benötigt|erfordert|erforderlich|notwendig|unterstützt|blockiert|zulassen
activar|active el|active javascript|activado|desactivado|habilitar|habilite|habilitado|requiere|requieren|necesita|necesario|no admite|bloquea|permitir
abilitare|abilita|abilitato|attivare|disabilitato|richiede|ative o|ativar|habilitar|desativado|requer|schakel|inschakelen|uitgeschakeld|vereist|aktivera|aktiverat|włącz|wymaga
有効にして|無効に|启用|禁用"""
DOC = """page|document|record|resource|full text|fulltext|website|web site|content|viewer|section|this url|file|article|publication
seite|dokument|volltext|volltextes|inhalt|datei|webseite|datensatz
le texte|document demandé|contenu|fichier|notice|site web
página|documento|el texto|contenido|archivo|registro|sitio
pagina|testo|contenuto|pagina web|conteúdo|arquivo|bestand|sidan|dokumentet|strony|strona|dokumentu
ページ|文書|页面|全文|文档|网页"""
SERVICE = """server|service|gateway|database|connection|session|request|requests|retrieval|loading|from your address|login|account|permission|access|network|host|proxy|upstream|certificate|rendering|website
dienst|datenbank|verbindung|sitzung|anfrage|anfragen|zugriff|zugang|beim laden|anmeldung|berechtigung
serveur|base de données|connexion|votre session|requête|requêtes|accès|autorisation|chargement|autorisé
servidor|servicio|base de datos|conexión|su sesión|solicitudes|acceso|permiso|al cargar|autorizado
servizio|sessione|richiesta|accesso|serviço|sessão|acesso|conexão|verbinding|toegang|sessie|tjänsten|åtkomst|usługa|dostęp|połączenie"""
BAD = """not found|cannot be found|could not be found|couldn't be found|can't be found|could not be located|could not find|couldn't find|can't find|unavailable|not available|no longer available|temporarily unavailable|does not exist|doesn't exist|no longer exists|expired|timed out|timeout|time-out|denied|forbidden|refused|unauthorized|not authorized|not authorised|do not have permission|don't have permission|don't have access|failed|failure|was lost|connection lost|too many|went wrong|isn't working|is not working|not working|not responding|unexpected error|error occurred|error has occurred|occurred while|cannot be displayed|can't be displayed|could not be displayed|cannot be shown|could not be shown|cannot be loaded|could not be loaded|can't be reached|cannot be reached|couldn't load|could not load|unable to load|unable to connect|unable to display|unable to process|can't reach|under maintenance|down for maintenance|scheduled maintenance|has been moved|has been removed|been deleted|overloaded|limit exceeded|quota exceeded|rate limit|too large|you are not logged in|must be logged in|must log in|bad request|bad gateway|internal server error|internal error|technical difficulties
nicht gefunden|nicht verfügbar|nicht erreichbar|nicht mehr verfügbar|existiert nicht|abgelaufen|zeitüberschreitung|verweigert|verboten|abgelehnt|nicht berechtigt|keine berechtigung|keinen zugriff|fehlgeschlagen|fehler aufgetreten|ist ein fehler|schiefgelaufen|schief gelaufen|nicht angezeigt werden|nicht dargestellt werden|nicht geladen werden|zu viele|interner serverfehler|serverfehler|unterbrochen|wartungsarbeiten|fehlerhafte anfrage
introuvable|indisponible|momentanément|n'est pas disponible|n'est plus disponible|n'existe pas|n'existe plus|a expiré|délai dépassé|refusé|interdit|non autorisé|a échoué|une erreur est survenue|erreur s'est produite|peut être affiché|peut être chargé|pas pu être|trop de requêtes|trop de|erreur interne|mal passé|perdue|en maintenance
no encontrada|no encontrado|no se encuentra|no se ha encontrado|no está disponible|no disponible|ya no está|no existe|ha caducado|ha expirado|tiempo de espera|denegado|prohibido|no autorizado|ha fallado|se produjo un error|se ha producido un error|ocurrió un error|puede mostrar|puede mostrarse|pudo cargar|demasiadas|error interno|salió mal|en mantenimiento
non trovata|non trovato|non è disponibile|non disponibile|scaduta|scaduto|negato|vietato|si è verificato un errore|errore interno|não encontrada|não encontrado|não está disponível|indisponível|expirou|negado|ocorreu um erro|erro interno|niet gevonden|niet beschikbaar|verlopen|geweigerd|er is een fout|kunde inte hittas|hittades inte|inte tillgänglig|nekad|nie znaleziono|niedostępna|wygasła|odmowa
見つかりません|利用できません|エラーが発生|不存在|找不到|未找到|无法显示|拒绝访问|出错"""
ERR = "error|errors|fehler|erreur|errore|erro code|fout|exception|エラー|错误"
ASK = """please|try again|reload|refresh|log in|login again|sign in|come back|contact the|administrator|go back|return to|click here|check back|later
bitte|erneut|versuchen sie|neu laden|anmelden|einloggen|veuillez|réessayer|réessayez|reconnecter|rechargez|por favor|inténtelo|vuelva a|recargue|iniciar sesión|riprova|tente novamente|probeer|försök|spróbuj|ください|请"""
FULL = "something went wrong|access denied|permission denied|too many requests|bad request|bad gateway|gateway timeout|gateway time-out|page not found|file not found|internal server error|interner serverfehler|erreur interne du serveur|error interno del servidor|accès refusé|zugriff verweigert|acceso denegado|accesso negato|acesso negado|zu viele anfragen|trop de requêtes|demasiadas solicitudes|service unavailable|session expired|session timed out|etwas ist schiefgelaufen|algo salió mal|une erreur est survenue|an error occurred|an unexpected error occurred|es ist ein fehler aufgetreten|se ha producido un error|ha ocurrido un error|ocurrió un error|si è verificato un errore|ocorreu um erro|er is een fout opgetreden|under maintenance|down for maintenance|wird gewartet|en cours de maintenance|en mantenimiento|are you a robot|verify you are human|checking your browser|unusual traffic"
#: The words of an unresolved reference field of a word processor.
FIELD_ERRORS = "reference source not found|bookmark not defined|no text of specified style in document|verweisquelle konnte nicht gefunden werden|textmarke nicht definiert|source du renvoi introuvable|signet non défini|no se encuentra el origen de la referencia|marcador no definido|origine riferimento non è stata trovata|segnalibro non è definito|fonte de referência não encontrada|indicador não definido|verwijzingsbron niet gevonden|not a valid link"
ORDER = """insert|enter|type|write|fill in|replace|complete|provide|describe|add your|put your|paste|state
einfügen|eintragen|eingeben|ergänzen|ausfüllen|ersetzen|insérer|saisir|saisissez|compléter|remplacer|rédiger|indiquer|décrire
insertar|introducir|completar|redactar|reemplazar|sustituir|escribir|rellenar|inserire|compilare|scrivere|inserir|preencher|invoegen|invullen"""
PART = """abstract|summary|title|description|claim text|claims|claim|field of the invention|background|embodiment|drawings|applicant|inventor|agent|attorney|text|reference number|application number|date
zusammenfassung|titel|beschreibung|anspruch|ansprüche|anspruchstext|anmelder|erfinder|bezeichnung|aktenzeichen
le résumé|résumé|titre|revendication|revendications|texte|déposant|inventeur|domaine
resumen|título|descripción|reivindicación|reivindicaciones|texto|solicitante
riassunto|titolo|descrizione|rivendicazione|testo|resumo|descrição|reivindicação|samenvatting|beschrijving"""
PLACE = """here|in this box|in this field|in this space|goes here|go here|to follow|below this line|this line|this text|this section
hier|an dieser stelle|diesen text|diese zeile|ici|cette ligne|ce texte|aquí|esta línea|este texto|qui il|qui la|aqui o|aqui a"""
PENDING = """to be completed|to be inserted|to be supplied|to be provided|to be added|to be written|to be determined|to be filled|to be confirmed|to be drafted|not yet written|text missing|missing text|replace before|goes here|placeholder for|this is a placeholder|text to follow|description to follow|under construction|coming soon|your text here|todo
noch auszufüllen|wird nachgereicht|noch einzufügen|steht später|platzhalter für|platzhaltertext|text fehlt|noch zu ergänzen|folgt noch
à compléter|texte manquant|à remplacer|remplacer avant|à rédiger|à insérer|à venir
por completar|pendiente de|completar antes|texto pendiente|falta el texto|por redactar|por definir
da inserire|da completare|da definire|a preencher|a completar|por preencher|nog in te vullen|tekst ontbreekt"""
REPORT = """is shown|are shown|is displayed|are displayed|appears on|displays|answers|answered|returns|returned|is returned|logged|logs|reported|reports|indicates|indicating|outputs|generates|generated|detects|detected|transmits|sends|receives|received|is raised|is issued|is sent|handles|counts|embodiment|invention|configured to|wherein|according to|denied by the|if the|when the|as soon as
erscheint|angezeigt wird|ausgegeben|protokolliert|gemeldet|zeigt|meldet|sendet|empfängt|dadurch gekennzeichnet|ausführungsform|verweigert von|wenn die|wenn der|wenn das|sobald d|falls d
s'affiche|est affiché|affiche|renvoie|signale|indique|envoie|reçoit|caractérisé|selon l|refusé par|si la session|si le|si l'
aparece|se muestra|muestra|devuelve|notifica|indica|envía|recibe|caracterizado|según|denegado por|si la sesión|si el"""
META = """message|messages|notice|reading|wording|placeholder|placeholders|tokens|variable such as|syntax|of the kind|of the type|of the form|such as
eine meldung|die meldung|der meldung|fehlermeldung|wortlaut|platzhalter|zeichen der art|zeichenkette|der art|der form
message d'erreur|libellé|jetons|marqueur|marqueurs|du type|de la forme|tels que|tel que
mensaje|mensajes|símbolos|marcador|marcadores|del tipo|de la forma|tales como|tal como"""
#: Words that messages are padded with; alone they say nothing.
OTHER = """this viewer|browser|your browser|sorry|oops|unfortunately|this site|this page|this app|this website|to continue|to view|to run|to work|work properly|properly|appears to be|requested|your request|you are looking for|looking for|you requested|you tried|on this server|this server|right now|at the moment|currently|temporarily|incident|support|the author|in order to|for this|full functionality|all features
der browser|ihr browser|browser ein|angeforderte|angeforderten|gewünschte|leider|derzeit|vorübergehend|anzuzeigen|fortzufahren|auf dieser seite|diese seite|diese webseite
votre navigateur|navigateur|demandée|demandé|désolé|actuellement|temporairement|pour afficher|afficher|pour continuer|cette page|cette visionneuse|ce document|ce site
su navegador|navegador|solicitada|solicitado|lo sentimos|actualmente|temporalmente|este visor|para ver|para mostrar|para continuar|esta página|este documento|este sitio
il browser|richiesta|richiesto|spiacenti|temporaneamente|temporariamente|solicitado|desculpe|seu navegador|questa pagina|per visualizzare|deze pagina|deze tekst|te lezen|te bekijken|uw browser|webbläsare|przeglądarka"""
#: Words that open a condition.
CONDITIONS = "if|when|whenever|unless|where|while|once|until|whether|in case|falls|wenn|sobald|sofern|solange|si|lorsque|lorsqu|quand|dès que|cuando|siempre que|hasta que|en cuanto|se|quando"
# Filler words, of which several stand side by side.
LATIN_FILLER = "lorem ipsum dolor sit amet consectetur consectet adipiscing adipis elit sed eiusmod tempor incididunt labore dolore magna aliqua enim veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat irure voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
KEYBOARD_FILLER = "foo bar baz qux asdf qwer qwerty jkl zzz xxx xxxx abc blah dummy sample test test1 test2 test3"
REPEATED_FILLER = "blindtext mustertext fauxtexte textodeprueba textoderelleno sampleparagraph placeholder dummyabstract abstractdummy dummytext sampletext beispieltext testodiprova platzhalter texttexttext"

# A placeholder is a name between delimiters, here in a text without blanks.
def _swapped(word: str) -> set[str]:
    """A word, and it with any two neighbouring letters exchanged."""
    return {word} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


def _any(*words: str) -> str:
    return "|".join(sorted(set().union(*map(_swapped, words)), key=lambda w: (-len(w), w)))


_NAME = r"[A-Za-z][\w.]{2,44}"
_ORDERS = ("insert", "insérer", "insertar", "einfügen", "enter", "saisir", "eingeben", "introducir", "inserire")
_PLACES = ("here", "hier", "ici", "aquí")
_TASKS = r"(?:TODO|TBD|TBC|FIXME|XXX|PLACEHOLDER|PLATZHALTER)"
_HELD = r"(?:applicant|inventor|assignee|company|client|customer|agent|attorney|your|first|last|product|project|document|file|author|anmelder|erfinder|déposant|inventeur|solicitante)"
_FORMS = [
    rf"\{{\{{{_NAME}\}}\}}", rf"<%=?{_NAME}%>", rf"\{{%[a-z]*{_NAME}%\}}", rf"[$#]\{{{_NAME}\}}", rf"%%{_NAME}%%", rf"@@{_NAME}@@", rf"\[\[{_NAME}\]\]", rf"\|\|\|{_NAME}\|\|\|",
    rf"«{_NAME}»", rf"<<{_NAME}>>", rf"__{_NAME}__", rf"\${_NAME}\$", rf"%\({_NAME}\)", rf"\{{{_NAME}\}}", rf"<(?!/?(?:p|br|b|i|em|sub|sup|div|span|li|ul|ol|table|tr|td|html|body)>){_NAME}>", rf"\[(?:{_any(*_ORDERS)})[^\]\[]{{2,60}}\]", rf"\[[^\]\[]{{2,60}}(?:{_any(*_PLACES)})\]", rf"\[\w{{1,3}}\[{_NAME}\]\]",
    rf"[\[<({{]{_TASKS}(?:[:\-–][^\]>)}}]{{0,80}})?[\]>)}}]", rf"\[{_HELD}[\w.'’]{{0,40}}\]",
]
_PLACEHOLDER = re.compile("|".join(f"(?:{f})" for f in _FORMS), re.I)
_MAY_HOLD = re.compile(r"\{[{%A-Za-z]|<[%<A-Za-z]|%%|%\(|[$#]\{|\$[A-Za-z]|@@|\[\[|\|\|\||«|__|\[[A-Za-z]")

_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


def _fold_table() -> dict[int, str | None]:
    """Code point -> its folded letter, or None where it is dropped."""
    table: dict[int, str | None] = {}
    for c in range(0x250):
        ch = chr(c)
        base = unicodedata.normalize("NFD", ch)[0].lower()
        base = {"ß": "s", "æ": "a", "ø": "o", "ł": "l", "ı": "i"}.get(base, base)
        table[c] = base if base.isalnum() else None
    table[ord("0")], table[ord("1")] = "o", "l"
    for c in (*range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0xFF00, 0xFF10), *range(0x300, 0x370)):
        table[c] = None
    return table


_FOLD = _fold_table()


def squeeze(text: str) -> str:
    """Without blanks, invisible signs, entities and compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = text.translate(_INVISIBLE)
    return "".join(text.split())


_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
#: Letters beyond the first 256 characters; texts without any are folded as bytes.
_FAR_LETTERS = re.compile("[\u0100-\u1fff\u2c00-\U0010ffff]")


def _as_bytes(table: dict[int, str | None]) -> tuple[bytes, bytes]:
    """A folding table as arguments of ``bytes.translate``."""
    kept = {c: table.get(c, chr(c)) for c in range(256)}
    return bytes(ord(v) if v and ord(v) < 256 else c for c, v in kept.items()), bytes(c for c, v in kept.items() if not v)


_FOLD_BYTES = _as_bytes(_FOLD)


def _translated(text: str, table: dict[int, str | None], as_bytes: tuple[bytes, bytes]) -> str:
    if _FAR_LETTERS.search(text):
        return text.translate(table)
    return text.encode("latin-1", "ignore").translate(*as_bytes).decode("latin-1")


def fold(squeezed: str) -> str:
    return _translated(squeezed, _FOLD, _FOLD_BYTES).replace("rn", "m")


_ROLES = ("SCRIPT", "NEED", "DOC", "SERVICE", "BAD", "ERR", "ASK", "FULL", "FIELD_ERRORS", "ORDER", "PART", "PLACE", "PENDING", "REPORT", "META", "OTHER", "CODE", "FILLER")
_SCRIPT, _NEED, _DOC, _SERVICE, _BAD, _ERR, _ASK, _FULL, _FIELD_ERROR, _ORDER, _PART, _PLACE, _PENDING, _REPORT, _META, _OTHER, _CODE, _FILLER = (1 << i for i in range(len(_ROLES)))
#: Letters between two words that count as covered, and letters that may stand before a phrase in its clause.
GAP, SLACK = 7, 10
#: Letters between two words of a phrase at most; what the words cover of their clause is judged apart.
REACH = 14
#: Letters that may follow a message that ends a text broken off, such as page navigation.
TAIL = 60


#: Letters looked at on either side of a word that can make a message; of an order or a place, which ordinary texts hold, fewer.
NEAR, NEAR_ORDER = 240, 70
_TRIGGERS = _SCRIPT | _BAD | _ERR | _FULL | _FIELD_ERROR | _ORDER | _PLACE | _PENDING | _FILLER


@lru_cache(maxsize=1)
def _automaton():
    """(words without one of which there is no message, all words)."""
    import ahocorasick

    found, triggers = ahocorasick.Automaton(), ahocorasick.Automaton()
    roles: dict[str, int] = {}

    def add(word: str, role: int) -> None:
        roles[word] = roles.get(word, 0) | role

    for role, name in enumerate(_ROLES[:-2]):
        for entry in globals()[name].replace("\n", "|").split("|"):
            whole = fold(squeeze(entry))
            forms = {whole}
            if len(whole) >= 5 and whole.isascii():
                forms |= {f.replace("rn", "m") for f in _swapped(squeeze(entry).translate(_FOLD))}
            # a neighbouring letter may have been taken together with the first or last one
            if len(whole) >= 7:
                forms |= {f[:-1] + "m" for f in forms if f[-1] == "r"} | {"m" + f[1:] for f in forms if f[0] == "n"}
            for f in forms:
                add(f, 1 << role)
    for code in (*range(400, 432), 451, *range(500, 512)):
        add(fold(str(code)), _CODE)
    for w in [w for w in (LATIN_FILLER + " " + REPEATED_FILLER).split() if len(w) > 4] + [a + b for a in KEYBOARD_FILLER.split() for b in KEYBOARD_FILLER.split()] + ["tbdtbdtbd"]:
        add(fold(squeeze(w)), _FILLER)
    roles.pop("entre", None)  # a word of its own, no misspelt order
    for word, role in roles.items():
        if role & ~_FILLER:
            found.add_word(word, (role & ~_FILLER, len(word)))
        if role & _TRIGGERS:
            triggers.add_word(word, (role, len(word)))
    found.make_automaton()
    triggers.make_automaton()
    return triggers, found


def _longest_first(words: str) -> str:
    """The folded words, those of four letters or more also with two neighbouring letters exchanged."""
    folded = [fold(squeeze(w)) for w in words.split()]
    return "|".join(sorted(set().union(*(_swapped(w) if len(w) > 3 else {w} for w in folded)), key=lambda w: (-len(w), w)))


_FILLER_RUN = re.compile(rf"(?:{_longest_first(LATIN_FILLER)}){{4,}}|(?:{_longest_first(KEYBOARD_FILLER)}){{4,}}|(?:{_longest_first(REPEATED_FILLER)}){{2,}}|(?:tbd){{3,}}")
_CUE = re.compile("|".join(sorted((fold(squeeze(w)) for w in META.replace("\n", "|").split("|")), key=len, reverse=True)))
_CONDITION = re.compile("(?:" + "|".join(fold(squeeze(w)) for w in CONDITIONS.split("|")) + ")")
# Forms of machine messages, here in a text without blanks.
_MACHINE = re.compile(r"at[A-Za-z_$][\w$]*(?:\.[\w$<>]+)+\([\w.$]+:\d+\)|Traceback\(mostrecentcalllast\)|ORA-\d{5}|SQLSTATE\[\w+\]|Fatalerror:|Warning:\w+\(\)|Uncaught\w*(?:Exception|Error)|NullPointerException|\[objectObject\]|#(?:REF|VALUE|DIV/0)!|#NAME\?|File\"[^\"]{1,80}\",line\d+")
_FRAME = re.compile(r"\(\w[\w.$]*:\s?\d")
_MACHINE_SIGNS = ("Traceback", "ORA-", "SQLSTATE", "Fatal error", "Warning:", "Uncaught", "NullPointer", "object Object", "#REF", "#VALUE", "#DIV", "#NAME", '", line')


def _may_be_machine(text: str) -> bool:
    return _FRAME.search(text) is not None or any(x in text for x in _MACHINE_SIGNS)


_PARAGRAPH = re.compile(r"\[\d{3,5}\]")
# A reference numeral, but no status code.
_NUMERAL = re.compile(r"\((?!\s?(?:4[0-3]\d|451|50\d|51[01])\s?\))\s?\d{1,4}[a-z]?\s?\)")
_TAG = re.compile(r"</?(?:p|br|b|i|em|strong|sub|sup|div|span|li|ul|ol|table|tr|td|h[1-6]|html|body|a)\s?/?>", re.I)
_OPEN_QUOTE = re.compile(r"(?<=\s)['‘’‚](?=\S)|(?<=[^\s])['’](?=[\s.,;:)]|$)")
_QUOTES = dict.fromkeys(map(ord, '"“”„‟«»‹›「」'), "\"")
_MARKS = re.compile(r"[\n.!\"#:^~<]")
# A capital behind a word without a stop between, or a wide blank: perhaps the rest of a text that broke off.
_CAPITAL = re.compile(r"(?<=[\w)]\s)(?=[A-ZÀ-Þ0-9][\w']+\s)")
_WIDE = re.compile(r"(?<=\S)[ \xa0]{2,}(?=\S)")


def _mark_table() -> dict[int, str | None]:
    """As :func:`_fold_table`, with signs that part clauses or quote kept: line end, full stop, colon, exclamation mark, quotation mark; ``#`` is a reference numeral."""
    table = dict(_FOLD)
    table.update({ord(c): "." for c in ".?;…。？；"} | {ord(c): "!" for c in "!！¡"} | {ord(c): ":" for c in ":："} | {ord("<"): "<", ord(">"): "<", ord("\n"): "\n", ord("\r"): "\n", 0x2028: "\n", 0x2029: "\n", ord("#"): "#", ord("^"): "^", ord("~"): "~"})
    for c in (9, 11, 12, 32, 0xA0, *range(0x2000, 0x2010), 0x202F, 0x205F, 0x3000):
        table[c] = None
    table.update(_QUOTES)
    return table


_MARKED = _mark_table()
_MARKED_BYTES = _as_bytes(_MARKED)
_QUOTE_CHARS = re.compile("[" + "".join(map(chr, _QUOTES)) + "]")


class _Clauses:
    """Where clauses begin and end in a folded text, as places between its letters."""

    def __init__(self, text: str, folded: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(r".\g<0>.", text)
        text = _CAPITAL.sub(r"^\g<0>", _WIDE.sub(r" ~", _PARAGRAPH.sub(r"\g<0>.", _OPEN_QUOTE.sub('"', _NUMERAL.sub(r"#\g<0>", text.replace("#", " ").replace("^", " ").replace("~", " "))))))
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _QUOTE_CHARS.sub('"', text))
            if _HIDDEN.search(text):
                text = text.translate(_INVISIBLE)
        marked = _translated(text, _MARKED, _MARKED_BYTES)
        # the folding of rn changes places, so it is done over marks too
        marked = re.sub(r"r([\n.!\"#:^~<]*)n", r"\1m", marked)
        self.folded = folded
        self.at: list[int] = []
        self.mark: list[str] = []
        for i, m in enumerate(_MARKS.finditer(marked)):
            self.at.append(m.start() - i)
            self.mark.append(m.group())
        self.good = len(marked) - len(self.mark) == len(folded)

    def begin(self, start: int) -> tuple[int, str] | None:
        """The last boundary at most ``SLACK`` letters before a place, and its mark; none where a quotation mark comes first."""
        i = bisect_left(self.at, start + 1) - 1
        while i >= 0 and start - self.at[i] <= SLACK:
            if self.mark[i] == '"':
                return None
            if self.mark[i] not in "#^~":
                return self.at[i], self.mark[i]
            i -= 1
        if start <= SLACK:
            return 0, "\n"
        i = bisect_left(self.at, start + 1) - 1
        return (self.at[i], "^") if i >= 0 and start - self.at[i] <= SLACK and self.mark[i] in "^~" else None

    def end(self, last: int) -> int:
        """The first boundary at or behind a place."""
        for i in range(bisect_left(self.at, last), len(self.at)):
            if self.mark[i] in "\n.!:<":
                return self.at[i]
        return len(self.folded)

    def wide(self, last: int) -> int:
        """The first wide blank at or behind a place, where a message and what follows it were set apart."""
        for i in range(bisect_left(self.at, last), len(self.at)):
            if self.mark[i] in "\n.!:<~":
                return self.at[i]
        return len(self.folded)

    def has(self, mark: str, start: int, end: int) -> bool:
        return any(self.mark[i] in mark for i in range(bisect_left(self.at, start), bisect_left(self.at, end + 1)))

    def quoted(self, start: int, end: int) -> bool:
        """Whether a quotation mark stands right before or behind a piece, or a word that names what follows leads to it."""
        if self.has('"', start - 3, start) or self.has('"', end, end + 2):
            return True
        before = max((self.at[i] for i in range(bisect_left(self.at, start - 40), bisect_left(self.at, start + 1)) if self.mark[i] in "\n.!"), default=start - 40)
        return _CUE.search(self.folded, max(0, before, start - 40), start) is not None


def _kind(roles: int, clause_end: bool) -> str | None:
    """What kind of message the roles of a phrase make."""
    if roles & _SCRIPT and roles & (_NEED | _BAD | _ASK):
        return "script"
    if roles & _FULL or roles & _BAD and roles & (_DOC | _SERVICE | _CODE | _ERR | _ASK) or roles & _ERR and roles & (_SERVICE | _CODE):
        return "error"
    if roles & _PENDING or roles & _ORDER and roles & _PART and roles & _PLACE or roles & _PART and roles & _PLACE and clause_end:
        return "template"
    if roles & _ORDER and roles & _PART and clause_end:
        return "order"
    return None


def _phrases(hits: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of hits at most ``REACH`` letters apart."""
    run: list[tuple[int, int, int]] = []
    reach = -99
    for hit in hits:
        if hit[0] - reach > REACH and run:
            yield run
            run = []
        run.append(hit)
        reach = max(reach, hit[1]) if len(run) > 1 else hit[1]
    if run:
        yield run


def _together(run: list[tuple[int, int, int]]) -> int:
    roles = 0
    for _, _, role in run:
        roles |= role
    return roles


def _covered(hits: list[tuple[int, int, int]]) -> int:
    """Letters that sorted hits cover, with those between two hits close together."""
    covered, reach = 0, None
    for start, end, _ in hits:
        if reach is None or start - reach > GAP:
            covered += end - start
        else:
            covered += max(0, end - reach)
        reach = end if reach is None else max(reach, end)
    return covered


def _message_spans(clauses: _Clauses, every: list[tuple[int, int, int]], runs: list[list[tuple[int, int, int]]], clause_share: float) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of messages in use."""
    done, whole = -1, len(clauses.folded)
    for run in runs:
        for i, (start, _, _) in enumerate(run):
            if start < done or (begin := clauses.begin(start)) is None:
                continue
            left, mark = begin
            roles = 0
            for _, end_j, role in run[i:]:
                roles |= role
                kind = _kind(roles, clauses.end(end_j) - end_j <= SLACK)
                if kind is None:
                    continue
                end = clauses.end(end_j)
                if mark == "^" and whole - end > TAIL:
                    break
                inside = [h for h in every[bisect_left(every, (start, 0, 0)) : bisect_left(every, (end, 0, 0))] if h[1] <= end]
                around = every[bisect_left(every, (left, 0, 0)) : bisect_left(every, (end, 0, 0))]
                said = [h for h in around if h[2] & (_REPORT | _META) and not any(o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in around)]
                covered = _covered(inside)
                if covered < clause_share * (end - left) and clauses.wide(end_j) < end:
                    end = clauses.wide(end_j)
                    inside = [h for h in inside if h[1] <= end]
                    covered = _covered(inside)
                if covered < clause_share * (end - left) or said or clauses.has("#", left + 1, end - 1) or clauses.has('"', left + 1, end + 1) or _CONDITION.match(clauses.folded, left) and left < start:
                    continue
                if kind == "order" and (covered < 0.85 * (end - left) or end - left > 40):
                    continue
                if mark == "<" and kind in ("order", "template") or mark == ":" and clauses.quoted(start, end):
                    continue
                last = max(h[1] for h in inside)
                yield start, last, "template" if kind == "order" else kind
                done = last
                break


def residue_spans(text: str, squeezed: str, folded: str, clause_share: float = 0.5, page_share: float = 0.6) -> list[tuple[str, str, int]]:
    """(kind, what stands there, letters) of each piece of residue in use."""
    triggers, words = _automaton()
    every, windows = 0, []
    for end, (role, length) in triggers.iter(folded):
        start = end + 1 - length
        if role & (_PLACE | _ORDER) and not role & ~(_PLACE | _ORDER | _PART):
            if role & _PLACE and start and folded.startswith("here", start) and (folded[start - 1] in "wp" or folded[start - 1] == "t" and folded[start - 2 : start] not in ("xt", "ct")):
                continue  # wherein, sphere, there; but text here, abstract here
            near = NEAR_ORDER
        else:
            near = NEAR
        every |= role
        if role != _FILLER:
            if windows and start - near <= windows[-1][1]:
                windows[-1] = [max(0, min(windows[-1][0], start - near)), max(windows[-1][1], end + near)]
            else:
                windows.append([max(0, start - near), end + near])
    hits = sorted((end + 1 - length, end + 1, role) for a, b in windows for end, (role, length) in words.iter(folded, a, min(b, len(folded))))
    out: list[tuple[str, str, int]] = []
    spans: list[tuple[int, int, str]] = []
    runs = [r for r in _phrases(hits) if _kind(roles := _together(r), True) or roles & (_ERR | _FIELD_ERROR | _BAD)]
    if runs:
        clauses = _Clauses(text, folded)
        if clauses.good:
            spans += _message_spans(clauses, hits, runs, clause_share)
            for start, end, role in (h for r in runs for h in r):
                if (role & _FIELD_ERROR or role & _ERR and clauses.has("!", end, end)) and not clauses.quoted(start, end):
                    spans.append((start, end, "error"))
            if not spans and not any(h[2] & (_REPORT | _META) for h in hits) and "#" not in clauses.mark:
                # a page of weak phrases: what they cover of the whole document decides
                weak = [(r[0][0], max(h[1] for h in r), "error") for r in runs]
                if sum(b - a for a, b, _ in weak) >= page_share * len(folded):
                    spans += weak
    if every & _FILLER:
        spans += [(*m.span(), "filler") for m in _FILLER_RUN.finditer(folded)]
    merged: list[list] = []
    for start, end, kind in sorted(spans):
        if merged and start <= merged[-1][1] + 2:  # sentences of one message
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out += [(kind, folded[start:end], end - start) for start, end, kind in merged]
    for kind, form in (("template", _PLACEHOLDER), ("error", _MACHINE)):
        if not (_MAY_HOLD.search(squeezed) if form is _PLACEHOLDER else _may_be_machine(text)):
            continue
        quoted_until = -99
        for m in form.finditer(squeezed):
            before, behind = squeezed[max(0, m.start() - 1) : m.start()], squeezed[m.end() : m.end() + 1]
            # the second of two quoted placeholders follows the first and a short "or"
            if m.start() - quoted_until <= 24 or before in _QUOTE_SIGNS and behind in _QUOTE_SIGNS and before or _named(squeezed, m.start()):
                quoted_until = m.end()
            else:
                out.append((kind, m.group(), len(fold(m.group()))))
    return out


_QUOTE_SIGNS = "\"'“”„‟‘’‚«»‹›"
_STOPS = re.compile(r"[.;!?](?=[^\w{}<>\[\]%$#@|]*[A-ZÀ-Þ])")


def _named(squeezed: str, start: int) -> bool:
    """Whether a word that names what follows stands up to 40 letters before a place, in the same sentence."""
    near = squeezed[max(0, start - 60) : start]
    stops = [m.end() for m in _STOPS.finditer(near)]
    return _CUE.search(fold(near[stops[-1] if stops else 0 :])[-40:]) is not None


def residue_of(text: str | None, clause_share: float = 0.5, page_share: float = 0.6) -> tuple[int, int, str]:
    """(letters of residue, letters, kinds found) of one text."""
    if not text:
        return 0, 0, ""
    squeezed = squeeze(text)
    folded = fold(squeezed)
    spans = residue_spans(text, squeezed, folded, clause_share, page_share)
    return sum(x[2] for x in spans), len(folded), ",".join(sorted({x[0] for x in spans}))


def _scan(clause_share: float, page_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residue_of(t, clause_share, page_share) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], names=["id", "residue_letters", "letters", "kinds"]
            )

    return run


def text_residue(df: DataFrame, text: str = "text", ident: str = "doc_id", clause_share: float = 0.5, page_share: float = 0.6) -> DataFrame:
    """Per row (doc_id, residue_letters, letters, kinds); kinds joined by commas, empty without residue.

    A message counts where the words of the vocabulary cover at least ``clause_share`` of its clause; a page of weak phrases
    where they cover at least ``page_share`` of the document. A null or empty text has no letters and no residue. Rows are judged one by one: repeated rows
    and null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    kind = dict(df.dtypes)[ident]
    return rows.mapInArrow(_scan(clause_share, page_share), f"id {kind}, residue_letters long, letters long, kinds string").withColumnRenamed("id", ident)


def with_residue(df: DataFrame, text: str = "text", ident: str = "doc_id", least_share: float = 0.0, clause_share: float = 0.5, page_share: float = 0.6) -> DataFrame:
    """The ids of texts to exclude: those of which more than ``least_share`` is residue.

    How much of a clause or page the matches cover decides what is residue (see :func:`text_residue`). The default excludes a
    document for a single value in a sentence too; a higher share keeps those and excludes pages made up of residue, whose share is near 1.
    """
    found = text_residue(df, text, ident, clause_share, page_share)
    return found.where(F.col("residue_letters") > F.lit(least_share) * F.col("letters")).select(ident)
