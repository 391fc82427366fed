"""Words of notes in English and Spanish: which language they are in, what they deny and choose, roots, and a glossary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry too little meaning to count, by language.
STOP = {
    "en": "a an and are as at be been but by can do for from has have if in into is it its of on or our should so than that the then there this to was we were when which with you".split(),
    "es": "al algo como con cual cuando de del desde donde el ella ellos en entre esa ese eso esta estas este esto estos hasta hay la las lo los muy para pero por porque que se segun ser si sobre su sus una unos".split(),
}
# Words that deny what follows, by language.
NEGATIONS = {"en": "not never no none don't doesn't avoid stop without instead rather".split(), "es": "no nunca ni sin jamas tampoco nada ninguno ninguna ningun evitar evita lugar vez".split()}
# Words that introduce what a decision picked, by language.
CHOICES = {"en": "use prefer choose adopt switch keep".split(), "es": "usar usamos preferir preferimos elegir elegimos escoger adoptar mantener cambiar".split()}
# Endings a root drops, the first that fits, by language, and letters that must stay.
ENDINGS = {"en": "ing ed es s".split(), "es": "aciones ación acion ando iendo ados idos ada ado ida ido es".split()}
ROOT_LETTERS = 4
# Letters with marks and what they fold to.
MARKED, PLAIN = "áàäéèëíìïóòöúùüñ", "aaaeeeiiiooouuun"
# Spanish words, or stems (marked *), and the English words for them in code.
GLOSSARY = """
abr* open; actualiz* update; agreg* add; anad* add; analiz* parse analyze; anul* cancel void; aplic* apply; asign* assign; autentic* auth authenticate; autoriz* authorize permission; borr* delete remove;
busc* search find; calcul* calculate compute; cambi* change; carg* load; cerr* close; cobr* charge payment; compar* compare; comprob* check verify; conect* connect; configur* config configuration;
consult* query; convert* convert; copi* copy; crea create; crean create; crear create; creado create; creada create; creacion create; descarg* download; deten* stop; devolv* return refund;
devuelv* return refund; dibuj* draw render; divid* split divide; edit* edit; elimin* delete remove; empiez* start; envi* send; escrib* write; estim* estimate; export* export; filtr* filter;
firm* sign signature; gener* generate; guard* save store; import* import; imprim* print; indexa* index; inici* start init; instal* install; lee read; leen read; leer read; leido read; lectura read;
limpi* clear clean; llam* call; mostr* show display render; muestr* show display render; mover move; mueve move; notific* notify notification; obten* get fetch; obtien* get fetch; orden* order sort;
paga pay payment; pagar pay payment; pagado pay payment; pagada pay payment; pago pay payment; pagos pay payment; pars* parse; proces* process; recib* receive receipt; recuper* recover fetch retrieve;
redim* redeem; registr* register record log; renderiz* render; reserv* reserve booking; resolv* resolve; resuelv* resolve; respond* respond response; restaur* restore; revis* review check; sincroniz* sync;
suscri* subscribe subscription; transform* transform; valid* validate; vend* sell sale; verific* verify check;
almacen* store storage warehouse; archiv* file; arista* edge; busqued* search; cantidad* quantity amount; carrito* cart; categori* category; client* client customer; clave* key password; codigo* code;
comando* command; comentari* comment; compania* company; conexion* connection; contrasena* password; correo* mail email; costo* cost; cuenta* account bill; cupon* coupon; dato* data; descuento* discount;
direccion* address; documento* document doc; empleado* employee; empresa* company; entrada* input entry; etiqueta* label tag; evento* event; factur* invoice bill; fecha* date; fichero* file;
funcion* function; grafo* graph; hora time hour; horas time hour; impuesto* tax; indice* index; informe* report; inventari* inventory stock; lenguaje* language; limite* limit; linea* line; llave* key;
memori* memory; mensaje* message; mesa table; mesas table; metodo* method; modulo* module; moneda* currency; monto* amount; nodo* node; nombre* name; numero* number count; objeto* object; pagina* page;
palabra* word; pantalla* screen; pedido* order; permiso* permission; plantilla* template; precio* price; presupuesto* budget; producto* product; propina* tip; proveedor* supplier vendor provider;
prueba* test; pregunta* question query; recibo* receipt; regla* rule; reporte* report; respuesta* response answer; rol role; roles role; ruta* route path; salida* output exit; servidor* server;
sesion* session; simbolo* symbol; sucursal* branch; tabla* table; tarea* task; tarjeta* card; tiempo* time; tienda* shop store; tipo* type; transacci* transaction; usuari* user; valor* value;
venta* sale; vista* view
"""
# What may follow a stem of the glossary.
STEM_ENDINGS = ["", *"s a as an ar e es en er ir o os ado ada ados adas ido ida idos idas ando iendo acion aciones cion ciones amos".split()]

TERMS = {key: words.split() for key, words in (entry.strip().split(" ", 1) for entry in GLOSSARY.split(";"))}


def note_words(text: Column) -> Column:
    """Small words of a note: runs of letters, digits, underscores and apostrophes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_']+"), lambda w: w != "")


def folded(word: Column) -> Column:
    """A word in small letters without its accents."""
    return F.translate(F.lower(word), MARKED, PLAIN)


def _count(words: Column, lang: str) -> Column:
    other = "es" if lang == "en" else "en"
    return F.size(F.filter(words, lambda w: w.isin([x for x in STOP[lang] if x not in STOP[other]])))


def tongue(words: Column) -> Column:
    """en or es by the number of their function words; a tie is English."""
    return F.when(_count(words, "es") > _count(words, "en"), "es").otherwise("en")


def reads_as_english(words: Column) -> Column:
    """Whether a question's words hold English function words, at least as many as Spanish ones."""
    plain = F.transform(words, folded)
    return (_count(plain, "en") > 0) & (_count(plain, "en") >= _count(plain, "es"))


def content_words(text: Column) -> Column:
    """Words of a note without the function words of its language."""
    words = note_words(text)
    return F.when(tongue(words) == "es", F.filter(words, lambda w: ~w.isin(STOP["es"]))).otherwise(F.filter(words, lambda w: ~w.isin(STOP["en"])))


def root_of(word: str, lang: str) -> str:
    """A word without the first ending of its language that leaves enough letters."""
    return next((word[: -len(e)] for e in ENDINGS[lang] if word.endswith(e) and len(word) - len(e) >= ROOT_LETTERS), word)


def root(word: Column, lang: Column) -> Column:
    """As `root_of`, as an expression."""

    def by(endings: list[str]) -> Column:
        fit = lambda e: F.endswith(word, F.lit(e)) & (F.length(word) - len(e) >= ROOT_LETTERS)
        return F.coalesce(*[F.when(fit(e), F.substring(word, F.lit(1), F.length(word) - len(e))) for e in endings], word)

    return F.when(lang == "es", by(ENDINGS["es"])).otherwise(by(ENDINGS["en"]))


def english_for(word: Column) -> Column:
    """The English words of a Spanish word: those of the longest entry that fits; none if no entry does."""
    known = F.create_map(*[x for key, words in TERMS.items() for x in (F.lit(key), F.array(*map(F.lit, words)))])
    w = folded(word)
    stems = [F.when(F.endswith(w, F.lit(e)), F.concat(F.substring(w, F.lit(1), F.length(w) - len(e)), F.lit("*"))) for e in STEM_ENDINGS]
    found = F.filter(F.array(w, *stems), lambda key: key.isNotNull() & F.map_contains_key(known, F.coalesce(key, F.lit(""))))
    longest = F.try_element_at(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.when(F.size(found) > 0, F.try_element_at(known, longest)).otherwise(F.array().cast("array<string>"))


def translated(words: Column) -> Column:
    """English words for Spanish ones, each once, in order, without those already among the words."""
    return F.array_except(F.array_distinct(F.flatten(F.transform(words, english_for))), words)
