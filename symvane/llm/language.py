"""Natural language hidden in code: which languages comments, strings and identifiers hold.

Masks (`masks.py`) leave the prose of a comment; its sentences are scored word by word with
interpolated Kneser-Ney character models, one per language, among the languages that use the
script of the run. The models are fitted on a bounded sample of labelled documents and on a
few common words; labels that the first models don't confirm are left out of the second fit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symvane.llm.masks import fenced_code, natural, prose
from symvane.llm.sentences import sentences

#: Labelled documents per language that the models are fitted on, and the longest taken.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 20_000
#: Characters of a model's n-grams, and its discount.
ORDER, DISCOUNT = 5, 0.75
#: Least running text of a language in a text.
LEAST_WORDS, LEAST_CHARS = 4, 8
#: Least words of a name in another language, and characters where words aren't parted.
NAME_WORDS, NAME_CHARS = 3, 5
#: Names need so much more log-probability a letter in the language than in English.
NAME_MARGIN = 0.15

# The languages, by script.
SCRIPTS = {"latin": ("en", "es", "de", "fr", "pt"), "cyrillic": ("ru",), "hangul": ("ko",), "arabic": ("ar",), "devanagari": ("hi",), "thai": ("th",), "han": ("zh", "ja")}
LANGUAGES = tuple(x for group in SCRIPTS.values() for x in group)
UNSPACED = {"zh", "ja", "th"}
# Common words of identifiers, which documents seldom hold.
COMMON = {
    "en": "get set load save read write open close delete remove update create find list count sum size name path file line row table key value user date time data empty valid used check compute parse merge split store handler index cache buffer queue node tree string number error result item",
    "es": "obtener guardar borrar eliminar leer escribir abrir cerrar comprobar buscar crear actualizar calcular cargar enviar archivo archivos ruta fecha hoy clave claves fila filas lista usuario usuarios permisos tamaño símbolo símbolos pendientes nombre valor datos vacío total suma entrada salida",
    "pt": "obter salvar excluir apagar ler escrever abrir fechar verificar buscar criar atualizar calcular carregar enviar arquivo arquivos caminho data hoje chave chaves linha linhas lista usuário usuários permissões tamanho símbolo válidas usados não nome valor dados vazio total soma entrada saída",
    "fr": "obtenir enregistrer supprimer effacer lire écrire ouvrir fermer vérifier chercher créer charger calculer envoyer fichier fichiers chemin date jour clé clés ligne lignes liste utilisateur droits taille symbole entrée réponse réponses données vide vides journal nom valeur somme sortie des",
    "de": "hole lade speichere lösche lese schreibe öffne schließe prüfe suche erstelle berechne sende datei dateien pfad datum heute schlüssel zeile zeilen liste benutzer rechte größe verzeichnis einträge gültige aller summe name wert daten leer ausgabe eingabe",
    "ru": "получить загрузить сохранить удалить прочитать записать открыть закрыть проверить найти создать вычислить отправить файл файлов путь дата ключ ключи строк список пользователь права размер таблицу записей пустые сумму имя значение данные",
}
# Latin letters for Russian ones.
_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_ROMAN = "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")
ROMAN = str.maketrans(dict(zip(_CYRILLIC, _ROMAN)))

_RUN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CAMEL = re.compile(r"[^\W\d_]*[^\W\d_A-Z][A-Z]")
_NAMED = "[A-Za-zÀ-ɏЀ-ӿ0-9]"
_PATH = re.compile(rf"(?<![!-~])[!-~]*(?:[/\\\\][!-~]+|[A-Za-z0-9]\.(?:[a-z]{{1,4}}|\w++\()(?![A-Za-z0-9])[!-~]*|[A-Za-z0-9]::[!-~]*|[A-Za-z0-9]\([!-~]*|[A-Za-z][0-9][!-~]*)|(?:(?<!{_NAMED}){_NAMED}++)?(?:_{_NAMED}*+)++\(?\)?")
_SIGNATURE = re.compile(r"^\W*(?:(?:pub|async|static|export|public|private|protected|final|override|virtual|inline|unsafe|extern|abstract)\s+)*(?:fn|def|func|function|let|const|var|val|class|struct|enum|interface|trait|impl|return|import|module|namespace|macro_rules!|type|int|void|bool|char|double|float|string|auto)\s+[&*]*\w+\s*(?:[(<{=:;]|$)|->|=>|:=|[;{}]\s*$|\)\s*[:{]\s*$", re.I)
_WORDS_OF_NAME = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ]+(?![^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ])|[A-ZÀ-ÖØ-ÞА-ЯЁ]?[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ]+")


def script_of(c: str) -> str | None:
    """The script of a letter, as far as it matters here."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latin"
    for first, last, name in ((0x400, 0x530, "cyrillic"), (0x600, 0x780, "arabic"), (0x8A0, 0x900, "arabic"), (0x900, 0x980, "devanagari"), (0xE00, 0xE80, "thai"), (0x1100, 0x1200, "hangul"), (0xAC00, 0xD7B0, "hangul"), (0x3040, 0x3100, "han"), (0x3400, 0xA000, "han"), (0xF900, 0xFB00, "han")):
        if first <= n < last:
            return name
    return None


class KneserNey:
    """Interpolated Kneser-Ney model of the characters of words."""

    def __init__(self, words: Counter[str]):
        grams: list[Counter[str]] = [Counter() for _ in range(ORDER)]
        for w, n in words.items():
            s = " " * (ORDER - 1) + w + " "
            for i in range(ORDER - 1, len(s)):
                grams[-1][s[i - ORDER + 1 : i + 1]] += n
        for k in range(ORDER - 1, 0, -1):  # lower orders count the kinds of left neighbours
            for g in grams[k]:
                grams[k - 1][g[1:]] += 1
        self.grams = grams
        self.total: list[dict[str, int]] = []
        self.kinds: list[Counter[str]] = []
        for level in grams:
            total, kinds = defaultdict(int), Counter()
            for g, n in level.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.total.append(dict(total))
            self.kinds.append(kinds)
        self.floor = 1 / 70_000

    def prob(self, gram: str) -> float:
        p = self.floor
        for k in range(ORDER):
            g = gram[ORDER - 1 - k :]
            t = self.total[k].get(g[:-1])
            if t:
                p = max(self.grams[k].get(g, 0) - DISCOUNT, 0) / t + DISCOUNT * self.kinds[k][g[:-1]] / t * p
        return p

    def score(self, word: str) -> float:
        s = " " * (ORDER - 1) + word + " "
        return sum(math.log(self.prob(s[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(s)))


def runs_of(text: str) -> list[tuple[str, list[str]]]:
    """The running text of a sentence as (script, words), without symbol names and paths."""
    out: dict[str, list[str]] = {}
    for run in _RUN.findall(_PATH.sub(" ", text)):
        if _CAMEL.match(run):
            rest = re.sub(r"[A-Za-z]+", " ", run)  # a name set inside a script without spaces
            parts = [p for p in rest.split() if not p.isascii()] if not run.isascii() and any(script_of(c) in ("han", "thai") for c in run) else []
        else:
            parts = [run]
        for part in parts:
            if part.isascii():
                out.setdefault("latin", []).append(part)
                continue
            now, start = script_of(part[0]), 0
            for i, c in enumerate(part):
                s = script_of(c)
                if s is not None and s != now:
                    if now and i > start:
                        out.setdefault(now, []).append(part[start:i])
                    now, start = s, i
            if now:
                out.setdefault(now, []).append(part[start:])
    return list(out.items())


def latin_prose(text: str) -> list[str]:
    """Latin words of a sentence in several scripts that stand in a row, at least LEAST_WORDS that are no acronyms."""
    out: list[str] = []
    row: list[str] = []
    for script, words in [x for run in _RUN.findall(_PATH.sub(" ", text)) for x in runs_of(run)] + [("", [])]:
        if script == "latin":
            row += words
            continue
        if sum(not w.isupper() for w in row) >= LEAST_WORDS:
            out += row
        row = []
    return out


def _fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def name_words(name: str) -> list[str]:
    return _WORDS_OF_NAME.findall(unicodedata.normalize("NFC", name))


class Detector:
    """Languages of texts and names; scores of words are kept."""

    def __init__(self, models: dict[str, KneserNey]):
        self.models = models
        self.known: dict[tuple[str, str], float] = {}

    @staticmethod
    def fit(labelled: list[tuple[str, str]]) -> Detector:
        """From (language, text). Words of identifiers in the texts teach the model of English names."""
        names: Counter[str] = Counter()
        rows: list[tuple[str, list[str]]] = []
        for (lang, text), clean in zip(labelled, prose([t for _, t in labelled])):
            for m in _RUN.finditer(text):
                if _CAMEL.match(m[0]) or text[m.end() : m.end() + 1] == "_":
                    names.update(w.casefold() for w in name_words(m[0]) if w.isascii())
            ws: list[str] = []
            for s, e in sentences(clean):
                if not _SIGNATURE.search(clean[s:e]):
                    ws += [w.casefold() for script, run in runs_of(clean[s:e]) for w in run if lang in SCRIPTS[script]]
            rows.append((lang, ws))

        def build(rows: list[tuple[str, list[str]]]) -> Detector:
            words: dict[str, Counter[str]] = {x: Counter() for x in LANGUAGES}
            for lang, ws in rows:
                words[lang].update(ws)
            for lang, common in COMMON.items():
                words[lang].update({w: 3 for w in common.split()})
            both = {lang: c if lang in SCRIPTS["han"] else Counter({w: min(n, 40) for w, n in c.items()}) for lang, c in words.items()}
            for lang in ("es", "de", "fr", "pt"):
                both[lang] += Counter({_fold(w): 1 for w in both[lang]})
            extra = {"ru-Latn": Counter({w.translate(ROMAN): n for w, n in both["ru"].items()}), "en-name": Counter({w: min(n, 40) for w, n in names.items()}) + both["en"]}
            return Detector({k: KneserNey(c) for k, c in (both | extra).items() if c})

        first = build(rows)
        return build([(lang, ws) for lang, ws in rows if ws and first.best([w for w in ws][:400], [g for g in SCRIPTS.values() if lang in g][0]) == lang])

    def score(self, model: str, word: str) -> float:
        found = self.known.get((model, word))
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[model, word] = self.models[model].score(word) if model in self.models else -20.0 * (len(word) + 1)
        return found

    def best(self, words: list[str], among: tuple[str, ...]) -> str:
        if len(among) == 1:
            return among[0]
        low = [w.casefold() for w in words]
        return max(among, key=lambda x: sum(self.score(x, w) for w in low))

    def sentence(self, text: str) -> list[tuple[str, list[str]]]:
        """(language, words) of a sentence."""
        out = []
        found = dict(runs_of(text))
        if len(found) > 1 and "latin" in found:  # single Latin words inside another script are names or terms
            other = sum(len(w) for k, ws in found.items() if k != "latin" for w in ws)
            if len(found["latin"]) < LEAST_WORDS or other > sum(map(len, found["latin"])):
                found["latin"] = latin_prose(text)
                if not found["latin"]:
                    del found["latin"]
        for script, ws in found.items():
            out.append((self.best(ws, SCRIPTS[script]), ws))
        return out

    def prose_languages(self, clean: str) -> dict[str, tuple[int, int]]:
        """Words and characters of each language in a text whose mask has been applied."""
        total: dict[str, list[int]] = {}

        def add(lang: str, words: list[str]) -> None:
            x = total.setdefault(lang, [0, 0])
            x[0], x[1] = x[0] + len(words), x[1] + sum(map(len, words))

        short: list[tuple[str, list[str]]] = []
        for s, e in sentences(clean):
            part = clean[s:e]
            for line in part.split("\n") if _SIGNATURE.search(part) else [part]:
                if not _SIGNATURE.search(line):
                    for lang, words in self.sentence(line):
                        if len(words) < LEAST_WORDS and lang in SCRIPTS["latin"]:
                            short.append((lang, words))
                        else:
                            add(lang, words)
        # too short to tell alone: counts with a language that is there anyway, or with others like it, else all that is left together
        pools: dict[str, list[str]] = {}
        for lang, words in short:
            pools.setdefault(lang, []).extend(words)
        rest: list[str] = []
        for lang, words in pools.items():
            if lang in total or len(words) >= LEAST_WORDS:
                add(lang, words)
            else:
                rest += words
        if rest and ((lang := self.best(rest, SCRIPTS["latin"])) in total or len(rest) >= LEAST_WORDS):
            add(lang, rest)
        return {k: (w, c) for k, (w, c) in total.items()}

    def languages(self, texts: list[str] | pa.Array) -> list[dict[str, tuple[int, int]]]:
        """Of comment texts the languages with enough running text: {language: (words, characters)}."""
        out = []
        for clean in prose(texts):
            found = self.prose_languages(clean)
            out.append({k: v for k, v in found.items() if (v[1] >= LEAST_CHARS if k in UNSPACED else v[0] >= LEAST_WORDS)})
        return out

    def name(self, name: str) -> str | None:
        """The language of a name that is made of words of a language other than English."""
        words = name_words(name)
        if not words:
            return None
        scripts = Counter(script_of(w[0]) for w in words)
        script = scripts.most_common(1)[0][0]
        if script not in SCRIPTS:
            return None
        if script != "latin":
            own = [w for w in words if script_of(w[0]) == script]
            lang = self.best(own, SCRIPTS[script])
            enough = sum(map(len, own)) >= NAME_CHARS if lang in UNSPACED else len(own) >= NAME_WORDS
            return lang if enough else None
        if len(words) < NAME_WORDS:
            return None
        low = [w.casefold() for w in words]
        letters = sum(len(w) + 1 for w in low)
        english = sum(max(self.score("en", w), self.score("en-name", w)) for w in low)
        scores = {x: sum(self.score(x, w) for w in low) for x in ("es", "de", "fr", "pt", "ru-Latn")}
        top = max(scores, key=scores.get)
        if scores[top] - english < NAME_MARGIN * letters:
            return None
        foreign = sum(self.score(top, w) > max(self.score("en", w), self.score("en-name", w)) for w in low)
        return top.split("-")[0] if foreign >= NAME_WORDS else None


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS documents a language, chosen by a hash of their id, whole texts."""
    lang = F.lower(F.substring(F.col(lang_col), 1, 2))
    short = docs.filter(lang.isin(*LANGUAGES) & F.length(text_col).between(1, SAMPLE_CHARS)).select(F.col(id_col).alias("i"), lang.alias("l"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = short.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_DOCS).select("i", "l")
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["i"]).select("i", "l", text_col).collect()  # bounded: SAMPLE_DOCS a language
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[1], str(r[0])))]


def languages(rows: DataFrame, id_col: str, doc_col: str, name_col: str, detector: Detector) -> DataFrame:
    """One row (id, field, lang, words, chars) per language of a row's comment text and of its name.

    Null, blank and short texts and names have none. Repeated rows come out as often as they are given.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(doc_col).alias("__doc"), F.col(name_col).alias("__name"))
    schema = T.StructType([slim.schema["id"], T.StructField("field", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("chars", T.IntegerType())])
    shared = slim.sparkSession.sparkContext.broadcast(detector.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Detector(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for row, found in enumerate(own.languages(batch.column(1))):
                out += [(row, "doc", k, w, c) for k, (w, c) in found.items()]
            for row, name in enumerate(batch.column(2).to_pylist()):
                if name and (lang := own.name(name)):
                    out.append((row, "name", lang, len(name_words(name)), len(name)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], names=["id", "field", "lang", "words", "chars"])

    return slim.mapInArrow(run, schema)


def source_languages(files: DataFrame, id_col: str, text_col: str, family_col: str, detector: Detector) -> DataFrame:
    """Languages of the comments and strings of whole source files: (id, part, lang, chars, share).

    `family_col` tells how the language marks comments (slash, hash, dash, star for excerpts of slash, mixed
    where it isn't known, fenced for prose of which only fenced code is source; others count as slash). `share` is of
    the file's characters. Null and empty files have no rows.
    """
    family = F.when(F.col(family_col).isin("hash", "dash", "star", "mixed", "fenced"), F.col(family_col)).otherwise("slash")
    slim = files.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), family.alias("__family"))
    schema = T.StructType([slim.schema["id"], T.StructField("part", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("chars", T.IntegerType()), T.StructField("share", T.DoubleType())])
    shared = slim.sparkSession.sparkContext.broadcast(detector.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Detector(shared.value)
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            families = batch.column(2).to_pylist()
            masked = natural([fenced_code(t) if f == "fenced" else t for t, f in zip(texts, families)], ["mixed" if f == "fenced" else f for f in families])
            for part, column in (("comment", [c for c, _ in masked]), ("string", [s for _, s in masked])):
                for row, found in enumerate(own.languages(column)):
                    out += [(row, part, k, c, c / len(texts[row])) for k, (_, c) in found.items()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], names=schema.names)

    return slim.mapInArrow(run, schema)
