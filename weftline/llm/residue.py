"""Template residue, filler, notices and error messages in place of content.

Labelled exemplars of residue are held in an inverted index from word to exemplar; all of one label
together are one more exemplar, as notices are worded in many ways from the same words. The content of
a page is read in overlapping windows of words; each window retrieves exemplars through its words
and is scored by the share of its TF-IDF weight that one exemplar contains. A page whose content
lies mostly in windows of high score is residue. Weights come from the whole corpus. More exemplars are
harvested from the corpus itself: texts that short pages with an error status have in common. Lines that
stand in many pages, mostly where nothing else is content, are residue too, whatever their words and the status.
Unfilled placeholders count wherever they stand in the content, unless a sentence speaks of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.http import declared_text
from weftline.llm.blocks import Block, Model, block_key, headline, label_pages, parse, train
from weftline.session import cut_lineage

#: Labelled exemplars of residue, by kind; a 9 stands for any number.
EXEMPLARS = {
    "error": """
        404 not found. The requested URL was not found on this server.
        404 page not found. The page you are looking for might have been removed, had its name changed or is temporarily unavailable.
        Sorry, the page you requested could not be found. It may have moved or no longer exists.
        This page does not exist. Check the address for typing errors, go back or return to the home page.
        Oops! That page can't be found. It looks like nothing was found at this location. Maybe try a search?
        We can't find the page you're looking for. The link you followed may be broken or the content has been deleted.
        The article or document you tried to open is no longer available or has expired.
        410 gone. The resource is no longer available on this server and there is no forwarding address.
        400 bad request. Your browser sent a request that this server could not understand.
        500 internal server error. The server encountered an internal error or misconfiguration and was unable to complete your request.
        Something went wrong. An error occurred while processing your request. Please try again later or contact the administrator.
        We are experiencing technical difficulties. Our team has been notified and is working on the problem.
        502 bad gateway. The proxy server received an invalid response from an upstream server.
        503 service unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
        The site is down for scheduled maintenance. We will be back online shortly. Thank you for your patience.
        504 gateway timeout. The upstream server did not respond in time. Connection timed out.
        Error establishing a database connection. Could not connect to the database server.
        Fatal error: uncaught exception thrown in file on line 9. Stack trace follows.
        Warning: undefined variable in script on line 9
        Traceback (most recent call last): file line 9 in module raise error
        java.lang.NullPointerException at org.apache.catalina.core. HTTP status 9, exception report, root cause, at java.lang.Thread.run(Thread.java:9)
        Server error in application. Runtime error. The current custom error settings prevent the details from being viewed.
        This site can't be reached. Check if there is a typo. The host name could not be resolved. DNS error.
        The domain is parked. This domain name may be for sale. Buy this domain. Inquire about this domain or contact the owner.
        This account has been suspended. Contact your hosting provider for more information. The bandwidth limit has been exceeded.
        Welcome to nginx! If you see this page, the web server is successfully installed and working. Further configuration is required.
        It works! This is the default web page for this server. Index of parent directory.
        Seite nicht gefunden. Die gewünschte oder aufgerufene Seite existiert nicht oder wurde verschoben.
        Es ist ein Fehler aufgetreten. Interner Serverfehler. Bitte versuchen Sie es später erneut.
        Page non trouvée, page introuvable. La page que vous recherchez n'existe pas ou a été déplacée.
        Une erreur est survenue. Erreur interne du serveur. Veuillez réessayer plus tard.
        Página no encontrada. La página que busca no existe o se ha movido.
        Se ha producido un error interno del servidor. Inténtelo de nuevo más tarde.
        Pagina non trovata. La pagina richiesta che cerchi non esiste o è stata spostata.
        Página não encontrada. A página que você procura não existe ou foi removida.
        Nie znaleziono strony. Strona, której szukasz, nie istnieje lub została przeniesiona.
        Страница не найдена. Запрошенная страница не существует или была удалена.
        Pagina niet gevonden. De pagina die u zoekt bestaat niet.
        """,
    "access": """
        403 forbidden. You don't have permission to access this resource on this server.
        Access denied. You are not authorized to view this page or resource. Error reference number 9.
        401 unauthorized. Authentication required. This server could not verify that you are authorized to access the document.
        Checking your browser before accessing the site. This process is automatic. Your browser will redirect shortly. Ray id 9
        Just a moment. Verifying that you are human. This may take a few seconds. The site needs to review the security of your connection.
        One more step. Please complete the security check to access the site. Solve the captcha to prove that you are not a robot.
        Please confirm you are a human by completing the challenge below. Press and hold the button.
        Our systems have detected unusual traffic or automated requests from your computer network.
        429 too many requests. You have sent too many requests in a given amount of time. Rate limit exceeded. Please try again later.
        Sorry, you have been blocked. Your IP address has been banned. You are unable to access this site.
        Please log in to continue. You must be signed in to view this page. Sign in or create an account.
        This content is for subscribers only. Subscribe or log in to continue reading.
        This content is not available in your country or region for legal reasons.
        Your session has expired. Please log in again.
        Zugriff verweigert. Sie haben keine Berechtigung, diese Seite oder Ressource aufzurufen oder anzuzeigen.
        Bitte bestätigen Sie, dass Sie kein Roboter sind. Zu viele Anfragen.
        Accès refusé, accès interdit. Vous n’êtes pas autorisé à accéder à cette page ou à la consulter.
        Veuillez confirmer que vous n'êtes pas un robot. Trop de requêtes.
        Acceso denegado. No tiene permiso o autorización para acceder a esta página o para verla.
        Confirme que no es un robot. Demasiadas solicitudes.
        Accesso negato. Acesso negado. Brak dostępu. Доступ запрещён.
        """,
    "scripts": """
        You need to enable JavaScript to run this app.
        Please enable JavaScript to view this page or use this site.
        JavaScript is disabled in your browser. Please turn it on or enable it in the settings and reload the page to continue.
        JavaScript is required. This site, page or application requires JavaScript to work or function properly.
        Your browser does not support JavaScript or it is currently disabled.
        We're sorry, but this application doesn't work properly without JavaScript enabled. Please enable it to continue.
        Please enable cookies and refresh the page. Cookies must be enabled.
        Your browser is out of date. Please upgrade to a modern supported browser.
        Loading, please wait.
        Redirecting. You will be redirected automatically. If you are not redirected or nothing happens, click here.
        Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite, Website oder Anwendung zu sehen, anzuzeigen oder zu nutzen.
        Veuillez activer JavaScript dans votre navigateur pour afficher cette page, le contenu ou ce site.
        Active o habilite JavaScript en su navegador para ver esta página o este sitio.
        Attiva JavaScript nel browser per visualizzare questa pagina. Ative o JavaScript para ver esta página.
        Włącz JavaScript w przeglądarce, aby wyświetlić tę stronę. Включите JavaScript, чтобы просмотреть эту страницу.
        """,
    "filler": """
        Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
        Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas aspernatur aut odit aut fugit
        The quick brown fox jumps over the lazy dog
        Blah blah blah. Bla bla bla.
        Text text text. Content content content. Word word word. Sample sample sample.
        asdf asdf qwer qwerty jkl asdfgh foo bar baz
        xxx xxx xxx yyy zzz
        test test test testing 9 this is a test, just a test page, please ignore
        Coming soon. Under construction. This page or section is under construction. New content will be added here soon. Watch this space.
        This is placeholder text. Replace this text with your own content. This is dummy copy. Copy goes here.
        Your text goes here. Add your text here. Enter text here. Click here or double click to edit and add text.
        Insert your headline here. Title goes here. Heading, subtitle, body and description go here. Insert image, link, caption or summary here.
        I'm a paragraph. Click here to add your own text and edit me. I'm a great place for you to tell a story and let your users know a little more about you.
        To do. To be added. To be announced. To be determined. Draft.
        Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
        This is an example page. It's different from a blog post because it will stay in one place. Sample page.
        Untitled document. New page. No title. No content. Default title. Empty page. Page title
        Hier steht Ihr Text. Dies ist ein Blindtext, Platzhalter oder Beispieltext. Fügen Sie hier Ihren Text ein.
        Votre texte ici. Ceci est un texte de remplacement, un exemple. Insérez votre texte ici.
        Su texto aquí. Este es un texto de ejemplo o de relleno. Escriba su texto aquí.
        """,
}
#: Forms of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\{%-?[^{}%]{1,60}-?%\}|\{%-? ?[a-z]+ |\$\{[^{}]{1,60}\}|<%=?[^%<>]{1,60}%>|@@\w{2,40}@@|__[A-Z][A-Z0-9_]{2,40}__"
    r"|(?<![\w%])%[A-Z][A-Z_]{2,40}%|\[(?:[A-Z]{3,}[A-Z _]{0,40}|(?:Insert|Your|Add|Enter|Type|Write) [^\][]{2,60})\]|\[\[[a-zA-Z_. ]{2,40}\]\]"
    r"|\bXX-[A-Z]+-XX\b|(?<![\w{$])\{[a-z][a-z_.]{2,40}\}|#[A-Z][A-Z_]{2,40}#|<<[A-Z][A-Z _]{2,40}>>|%%[A-Za-z]\w{1,40}%%"
)
#: Words by which a sentence speaks of placeholders instead of having one.
_SPEAKS = re.compile(r"\b(?:tags?|placeholders?|such as|called|named|variables?|explains?|writes?|syntax|marker|field)\b[^.]{0,60}$", re.I)

#: Words of a window; score of a residue window under one exemplar, and under all of a label; share that makes a page residue.
WINDOW, SCORE, LABEL_SCORE, COVERED = 8, 0.72, 0.8, 0.5
#: Fewest words of a window that all of a label may cover: fewer words stand together by chance.
LABEL_WINDOW = 5
#: Harvested exemplars: words of a page that is nothing but a notice, pages that must have a text in common, and their share.
SHORT_PAGE, COMMON, COMMON_SHARE = 60, 3, 0.002
#: Share of the pages with a line in which nothing else is content, from which on the line is residue.
ALONE = 0.5
#: Blocks of at least this probability are content here: a notice may be all that a page has.
CONTENT = 0.25

_WORDS = re.compile(r"[^\W\d_]+|\d+")
_DIGIT = re.compile(r"\d")
#: Bytes of text in lower case: ASCII letters stay, as do bytes outside ASCII; all else is space.
_APART = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32()), ("hit", pa.int32())]))
_HOST = re.compile(r"\b(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,}\b")
_NOSCRIPT = re.compile(r"<noscript[^>]*>(.*?)(?:</noscript\s*>|\Z)", re.I | re.S)


def words_of(text: str) -> list[str]:
    return ["9" if w[0].isdigit() else w for w in _WORDS.findall(text.lower())]


class Index(NamedTuple):
    """Inverted index of the exemplars with the weights of the words."""

    of: dict[str, tuple[int, ...]]  # word -> exemplars; -1 and below: all of a label
    given: int  # exemplars that were given; those from here on are harvested
    weight: dict[str, float]
    rare: float  # weight of a word that no exemplar has


def exemplars() -> list[tuple[str, set[str]]]:
    return [(kind, set(words_of(line))) for kind, block in EXEMPLARS.items() for line in block.strip().splitlines()]


def vocabulary() -> set[str]:
    return set().union(*(words for _, words in exemplars()))


def build_index(texts: int, frequency: dict[str, int], harvested: Iterable[str] = ()) -> Index:
    """Index with inverse document frequencies from the corpus; ``harvested`` are more exemplars as joined words."""
    of: dict[str, list[int]] = {}
    labels = {kind: -1 - k for k, kind in enumerate(EXEMPLARS)}
    for n, (kind, words) in enumerate(exemplars()):
        for w in words:
            of.setdefault(w, []).append(n)
            if labels[kind] not in of[w]:
                of[w].append(labels[kind])
    given = len(exemplars())
    for n, line in enumerate(sorted(harvested), given):
        for w in set(line.split(" ")):
            of.setdefault(w, []).append(n)
    weight = {w: math.log((texts + 1) / (frequency.get(w, 0) + 1)) + 0.1 for w in of}
    return Index({w: tuple(v) for w, v in of.items()}, given, weight, math.log(texts + 1) / 2 + 0.1)


def covered_words(words: list[str], index: Index, labels: bool = True) -> np.ndarray:
    """Which words of a passage lie in a window that one exemplar contains to at least ``SCORE``, or (``labels``) all of a label to ``LABEL_SCORE``; harvested exemplars count with ``labels`` only."""
    n = len(words)
    hit = np.zeros(n, bool)
    size = min(WINDOW, n)
    if not n or n > 60 and not _may_cover(words, index):
        return hit
    weight = [index.weight.get(w, -index.rare) for w in words]
    of_known = [w if w > 0 else 0.0 for w in weight]
    # A window with a word of no exemplar needs this much from the others; one without is a run of known words.
    if (1 - SCORE) * sum(of_known) < SCORE * index.rare - 1e-6 and "k" * size not in "".join(["k" if w > 0 else "u" for w in weight]):
        return hit
    total = [0.0, *accumulate(map(abs, weight))]
    known = [0.0, *accumulate(of_known)]
    numbers = [0, *accumulate(w == "9" for w in words)]
    labels, harvested = labels and size >= LABEL_WINDOW, labels
    for a in range(n - size + 1):
        need = SCORE * (total[a + size] - total[a])
        if known[a + size] - known[a] < need:  # not even all exemplars together have enough
            continue
        if 2 * (numbers[a + size] - numbers[a]) > size:  # a table is in no exemplar, although each of its numbers is
            continue
        per: dict[int, float] = {}
        for k in range(a, a + size):
            for e in index.of.get(words[k], ()):
                per[e] = per.get(e, 0.0) + weight[k]
        one, all_of = 0.0, 0.0
        for e, got in per.items():
            if 0 <= e < index.given or e >= 0 and harvested:
                one = max(one, got)
            elif e < 0:
                all_of = max(all_of, got)
        if one >= need or labels and all_of * SCORE >= need * LABEL_SCORE:
            hit[a : a + size] = True
    return hit


def _may_cover(words: list[str], index: Index) -> bool:
    """Whether some window of a long passage has enough words of exemplars, whichever they are."""
    weight = np.fromiter((index.weight.get(w, -index.rare) for w in words), np.float64, len(words))
    total, known = np.cumsum(np.abs(weight)), np.cumsum(np.maximum(weight, 0))
    size = WINDOW
    whole = np.append(total[size - 1], total[size:] - total[:-size])
    part = np.append(known[size - 1], known[size:] - known[:-size])
    numbers = np.cumsum(np.fromiter((w == "9" for w in words), np.int64, len(words)))
    numbers = np.append(numbers[size - 1], numbers[size:] - numbers[:-size])
    return bool(((part >= SCORE * whole - 1e-9) & (2 * numbers <= size)).any())


def placeholders(text: str) -> bool:
    """Whether a text has an unfilled placeholder that it does not merely speak of."""
    if not ("{" in text or "[" in text or "%" in text or "__" in text or "@@" in text or "XX-" in text or "#" in text or "<<" in text):
        return False
    return any(not _SPEAKS.search(text[max(0, m.start() - 80) : m.start()]) for m in PLACEHOLDER.finditer(text))


class Line(NamedTuple):
    """One line of content: digest of its words, their number, how many are residue by the exemplars."""

    line: int
    words: int
    hit: int


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def line_key(text: str, words: list[str]) -> int:
    """Digest of a line's words without host names, so that a notice that names its site is one line everywhere."""
    if "." in text[:-1] and _HOST.search(text):
        words = words_of(_HOST.sub(" ", text))
    return _digest(" ".join(words))


class Reader:
    """Reads lines by an index; what short texts give is kept, as menus and notices come again and again."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.kept: dict[tuple[str, bool], Line] = {}

    def __call__(self, text: str, labels: bool = True) -> Line:
        if (got := self.kept.get((text, labels))) is None:
            words = words_of(text)
            got = Line(line_key(text, words) if len(words) <= SHORT_PAGE else 0, len(words), int(covered_words(words, self.index, labels).sum()))
            if len(text) <= 200:
                if len(self.kept) > 50_000:
                    self.kept.clear()
                self.kept[text, labels] = got
        return got


def content_lines(blocks: list[Block], title: str, score: np.ndarray, page: str, read: Reader) -> tuple[list[Line], list[int], bool]:
    """Lines that decide about a page, keys of its other lines, and whether content has placeholders."""
    top = headline(blocks, title)
    lines: list[Line] = []
    whole: list[Line] = []  # a headline that is no notice itself counts only where nothing else is content
    rest: list[int] = []
    content = []
    for i, (b, s) in enumerate(zip(blocks, score)):
        if b.linked > 0.5:
            continue
        line = read(b.text, bool(s >= CONTENT))
        # A block that is nothing but residue is content wherever the labeller sees it.
        if s < CONTENT and (not line.hit or line.hit < SCORE * line.words):
            rest.append(line.line)
            continue
        content.append(b)
        if top < 0 and len(content) == 1 and b.text[-1] not in ".!?…:":
            top = i
        if i == top and line.hit < line.words:
            whole.append(line)
        else:
            lines.append(line)
    has = any(placeholders(b.text) for b in content)
    if any(x.words for x in lines):
        rest += [x.line for x in whole]
    else:
        lines = whole
    if own := [x for x in lines if x.words]:
        return own, rest, has
    others = [b.text for b in blocks if b.linked < 0.5] or [re.sub(r"<[^>]*>", " ", t) for t in _NOSCRIPT.findall(page)]
    return [x for x in map(read, others) if x.words], [], has


def harvest(df: DataFrame, key: str, body: str, charset: Column, status: Column) -> list[str]:
    """Texts (as joined words) of blocks that short pages with an error status have in common; sorted.

    A block counts where the whole page has at most ``SHORT_PAGE`` words beside links and scripts, once per
    key. It must stand in ``COMMON`` pages, and in the share ``COMMON_SHARE`` of the short error pages: as a page
    has at most ``SHORT_PAGE`` / 3 blocks, no more than ``SHORT_PAGE`` / 3 / ``COMMON_SHARE`` texts reach the driver.
    """
    rows = df.where((status >= 400) & (F.length(df[body]) > 0)).select(df[key].cast("string").alias("k"), df[body].alias("b"), charset.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = [], []
            for k, b, c in zip(*batch.columns):
                blocks, _ = parse(declared_text(b.as_py(), c.as_py()))
                words = [words_of(x.text) for x in blocks if x.linked < 0.5]
                if 0 < sum(map(len, words)) <= SHORT_PAGE:
                    found = {" ".join(w) for w in words if len(w) >= 3} | {""}  # the empty one counts the page
                    keys += [k.as_py()] * len(found)
                    lines += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], ["k", "line"])

    counts = rows.mapInArrow(run, "k string, line string").distinct().groupBy("line").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    pages = counts.where("line = ''").agg(F.sum("n")).first()[0] or 0
    least = max(COMMON, COMMON_SHARE * pages)
    return sorted(r["line"] for r in counts.where((F.col("line") != "") & (F.col("n") >= least)).collect())


def frequencies(df: DataFrame, body: str, charset: Column, harvested: Iterable[str] = ()) -> tuple[int, dict[str, int]]:
    """Pages of ``df`` and, for each word of the exemplars, in how many of them it stands; any number is a 9."""
    known = vocabulary().union(*(line.split(" ") for line in harvested))
    written = {w.encode(): w for w in known}
    ascii_words = frozenset(w for w in written if w.isascii())
    rows = df.where(F.length(df[body]) > 0).select(df[body].alias("b"), charset.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, dict.fromkeys(known, 0)
        inside: dict[bytes, set[str]] = {}  # known words in parts outside ASCII, whose punctuation is not taken apart yet
        for batch in batches:
            for b, c in zip(batch.column(0), batch.column(1)):
                total += 1
                text = declared_text(b.as_py(), c.as_py()).lower()
                parts = text.encode("utf-8", "replace").translate(_APART).split()
                found = {written[w] for w in ascii_words.intersection(parts)}
                if not text.isascii():
                    for w in [w for w in parts if not w.isascii()]:
                        if (got := inside.get(w)) is None:
                            if len(inside) > 50_000:
                                inside.clear()
                            got = known.intersection(words_of(w.decode()))
                            if len(w) <= 100:
                                inside[w] = got
                        found |= got
                if _DIGIT.search(text):
                    found.add("9")
                for w in found & known:
                    counts[w] += 1
        counts[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    got = {r["w"]: r["n"] or 0 for r in rows.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def read_pages(
    df: DataFrame, key: str, body: str, charset: Column, model: Model | None = None, index: Index | None = None, keys: bool = True
) -> DataFrame:
    """(key, covered, placeholders, block_keys array): what each page's content is.

    ``covered`` is the share of the content in residue windows or in lines that stand alone (``alone``),
    ``block_keys`` the distinct keys of the main blocks in order; without ``keys`` they are null. Null and
    empty bodies have no row. Repeated rows give repeated results, other columns are left behind. Every page
    is read once, row by row; model and index (fixed sizes) are broadcast. What is read is checkpointed.
    """
    rows = df.select(df[key].alias("k"), df[body].alias("b"), charset.alias("c")).where(F.length(df[body]) > 0)
    model = model or train(df, body, charset, key)
    index = index or build_index(*frequencies(df, body, charset))
    shipped = df.sparkSession.sparkContext.broadcast((model, index))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, exemplar_index = shipped.value
        reader = Reader(exemplar_index)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [declared_text(b.as_py(), c.as_py()) for b, c in zip(part.column(1), part.column(2))]
                pages = [parse(t) for t in texts]
                lines, rest, place, found = [], [], [], []
                titles = [_digest(title or text) for text, (_, title) in zip(texts, pages)]
                for text, (blocks, title), s in zip(texts, pages, label_pages(net, pages)):
                    decisive, others, has = content_lines(blocks, title, s, text, reader)
                    lines.append([x._asdict() for x in decisive])
                    rest.append(others)
                    place.append(has)
                    main = dict.fromkeys(block_key(b.text) for b, p in zip(blocks, s) if p >= 0.5) if keys else None
                    if main:
                        main.pop("", None)
                    found.append(None if main is None else list(main))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(titles, pa.int64()), pa.array(lines, _LINES), pa.array(rest, pa.list_(pa.int64())), pa.array(place, pa.bool_()), pa.array(found, pa.list_(pa.string()))],
                    ["k", "title", "lines", "rest", "placeholders", "block_keys"],
                )

    schema = f"k {kind}, title bigint, lines array<struct<line bigint, words int, hit int>>, rest array<bigint>, placeholders boolean, block_keys array<string>"
    read = cut_lineage(rows.mapInArrow(run, schema))
    residue_lines = alone(read)
    hit = F.aggregate("lines", F.lit(0), lambda n, x: n + F.when(x["line"].isin(residue_lines), x["words"]).otherwise(x["hit"]))
    words = F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"])
    covered = F.when(words > 0, hit / words).otherwise(0.0)
    return read.select(F.col("k").alias(key), covered.alias("covered"), "placeholders", "block_keys")


def alone(read: DataFrame) -> list[int]:
    """Keys of the lines that stand in many pages, mostly where nothing else is content; sorted.

    ``read`` has k, title, lines and rest of each page. A page counts as short by ``SHORT_PAGE``; a line must stand
    in ``COMMON`` short pages and in the share ``COMMON_SHARE`` of them, so no more than ``SHORT_PAGE`` /
    ``COMMON_SHARE`` lines reach the driver. It is residue if as many short pages, and ``ALONE`` of all pages that
    have it anywhere, have no content but such lines and residue. Once per key; pages must have ``COMMON`` titles
    among them, as one article may be fetched often.
    """
    words = F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"])
    short = read.where(words <= SHORT_PAGE)
    lines = short.select("k", "title", F.explode("lines").alias("x")).select("k", "title", "x.*")
    least = max(COMMON, COMMON_SHARE * short.select("k").distinct().count())
    many = (F.col("n") >= least) & (F.col("titles") >= COMMON)

    def counted(df: DataFrame) -> DataFrame:
        return df.select("k", "title", "line").distinct().groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))

    common = cut_lineage(counted(lines.where("line != 0")).where(many).select("line", F.lit(True).alias("common")))
    marked = lines.join(F.broadcast(common), "line", "left")
    known = F.coalesce("common", F.lit(False))
    bare = marked.groupBy("k", "title").agg(F.bool_and(known | (F.col("hit") >= F.col("words"))).alias("bare"), F.collect_set(F.when(known, F.col("line"))).alias("line"))
    by_itself = counted(bare.where("bare").select("k", "title", F.explode("line").alias("line"))).where(many)
    everywhere = read.select("k", F.explode(F.array_union(F.transform("lines", lambda x: x["line"]), "rest")).alias("line"))
    total = everywhere.join(F.broadcast(common), "line").select("k", "line").distinct().groupBy("line").agg(F.count("*").alias("of"))
    found = by_itself.join(total, "line").where(F.col("n") >= ALONE * F.col("of"))
    return sorted(r["line"] for r in found.select("line").collect())


def read_texts(df: DataFrame, key: str, body: str, charset: Column, index: Index) -> DataFrame:
    """(key, covered, placeholders) of bodies that are no pages: the text is one passage. Otherwise as ``read_pages``."""
    rows = df.select(df[key].alias("k"), df[body].alias("b"), charset.alias("c")).where(F.length(df[body]) > 0)
    shipped = df.sparkSession.sparkContext.broadcast(index)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, place = [], []
            for b, c in zip(batch.column(1), batch.column(2)):
                text = declared_text(b.as_py(), c.as_py())
                words = words_of(text)
                total = len(words)
                found = int(covered_words(words, shipped.value).sum())
                share.append(found / total if total else 0.0)
                place.append(placeholders(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(share, pa.float64()), pa.array(place, pa.bool_())], ["k", "covered", "placeholders"]
            )

    return rows.mapInArrow(run, f"k {kind}, covered double, placeholders boolean").withColumnRenamed("k", key)


def is_residue() -> Column:
    """Condition on the columns of ``read_pages``: the page is to be left out."""
    return (F.col("covered") >= COVERED) | F.col("placeholders")
