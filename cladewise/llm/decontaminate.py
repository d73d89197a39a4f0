"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its template. Windows of
template tokens, and of the words as they are, are hashed and joined between documents and benchmark items. Matches on one diagonal (document place minus
item place) are then judged slot by slot: a window counts if its slots are equal, or if none goes against the value that most
places of the diagonal give. Different values may meet in one, as they do in re-parameterised questions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, apart, broadcast_if_small, signed, slices, small_batches, split_words, stored

#: Tokens in a window, and how many of them must be words.
WINDOW, LITERALS = 8, 4
#: Bits of the filter that executors get of the benchmark's windows; its size is the same for any benchmark.
FILTER_BITS = 1 << 22
#: Leaking documents whose ids may be sent to all executors; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
NO_ID = -(1 << 63)

# Units of measure, numbers in words and function words, in English, German, French and Spanish.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms ton tons "
    "ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees mph kmh hz khz mhz ghz w kw mw v a kb mb gb tb meter meters metre metres "
    "millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres kilometer kilometers kilometre kilometres milliliter milliliters millilitre millilitres "
    "zoll fuß meile meilen gramm kilogramm pfund tonne tonnen metern kilometern sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent uhr "
    "mètre mètres millimètre millimètres centimètre centimètres kilomètre kilomètres pouce pouces pied pieds gramme grammes kilogramme kilogrammes kilo kilos tonnes seconde secondes heure heures "
    "jour jours semaine semaines mois an ans année années livre livres degré degrés centime centimes "
    "metro metros milímetro milímetros centímetro centímetros kilómetro kilómetros pulgada pulgadas pie pies milla millas gramo gramos kilogramo kilogramos tonelada toneladas litro litros mililitro mililitros "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años libra libras dólar dólares grado grados céntimo céntimos peso pesos"
).split()
_DIGITS = "ein zwei drei vier fünf sechs sieben acht neun".split()
_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
NUMBERS = [
    *(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
        "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million millions billion billions "
        "null eins zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend millionen milliarde milliarden "
        "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante mille cents milliard milliards "
        "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro "
        "veinticinco veintiséis veintisiete veintiocho veintinueve treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos quinientos mil millón millones"
    ).split(),
    *_DIGITS[1:], *_TENS, *[f"{d}und{t}" for d in _DIGITS for t in _TENS], *[d + h for d in _DIGITS for h in ("hundert", "tausend")],
]
FUNCTION_WORDS = (
    "a an the this that these those i you he she it we they his her its our their my your who whom whose which what when where why how there here and or but nor so yet if then else than as because while "
    "although though since until unless after before during of in on at by for from to into onto with without about above below between over under through against is are was were be been being am do does did "
    "has have had can could will would shall should may might must not no yes all any each every some many much more most few both one other another such only also just now let given suppose find "
    "der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als weil während obwohl da nach vor in im an am auf aus bei mit ohne von vom zu zum zur für über unter zwischen durch gegen um "
    "ist sind war waren wird werden hat haben hatte kann können soll muss nicht kein keine ich du er sie es wir ihr sein seine ihre wer was wie wo wann warum welche welcher welches dieser diese dieses jede jeder jedes alle "
    "le la les l un une des du de d et ou mais si alors car que qui quoi quel quelle quels quelles quand où comment pourquoi combien à au aux en dans sur sous avec sans pour par entre vers chez avant après pendant "
    "est sont était étaient a ont avait il elle ils elles on je tu nous vous ce cet cette ces son sa ses leur leurs mon ma mes ne pas plus tout toute tous toutes chaque "
    "el lo los las uno una unos unas del al y o u pero si entonces porque cuando donde como qué quién cuál cuáles cuándo dónde cómo cuánto cuánta cuántos cuántas con sin por para sobre bajo entre hasta desde hacia según "
    "es son era eran está están fue hay ha han había él ella ellos ellas yo nosotros su sus mi mis este esta estos estas ese esa eso cada todo toda todos todas no sí se que"
).split()

_CORE = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_MEASURED = re.compile(r"[+-]?\d[\d.,]*([a-z]+)")
_PLACE = {"num": 1, "name": 2, "unit": 3, "measure": 4}
WORD, NUMBER, UNIT, CAPITAL, MEASURE, EMPTY = range(6)
#: What a window's hash is made of: the words as they are, templates by place in the sentence, templates by word.
PLAIN, BY_PLACE, BY_WORD = range(3)


def _is_number(low: str) -> bool:
    return bool(_NUMBER.fullmatch(low)) or low in _NUMBER_SET or ("-" in low and all(p in _NUMBER_SET or p in ("et", "un", "une", "cent") for p in low.split("-")))


def _facts(word: str) -> tuple[int, int, bool, bool]:
    """Code of the bare word, its kind, whether it closes a sentence and whether it may be a name wherever it stands."""
    core = _CORE.sub("", word)
    low = core.lower()
    closes = word.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    if not core:
        return 0, EMPTY, closes, False
    name = False
    if _is_number(low):
        kind = NUMBER
    elif low in _UNIT_SET:
        kind = UNIT
    elif (m := _MEASURED.fullmatch(low)) and m[1] in _UNIT_SET:
        kind = MEASURE
    else:
        kind = CAPITAL if len(core) > 1 and core[0].isupper() and core[1:].islower() else WORD
        name = len(core) > 1 and core[0].isupper() and low not in _FUNCTION_SET
    return xxhash.xxh3_64_intdigest(low), kind, closes, name


_UNIT_SET, _NUMBER_SET, _FUNCTION_SET = frozenset(UNITS), frozenset(NUMBERS), frozenset(FUNCTION_WORDS)


class Templates:
    """Tokens of a batch of texts: ends by text, and for PLAIN, BY_PLACE and BY_WORD their codes and slot values (0: a
    literal word). BY_PLACE takes capitalised words inside a sentence for names, BY_WORD all capitalised words but function
    words. Hashes of PLAIN do not depend on what stands around a window or on capitals."""

    def __init__(self, texts: pa.Array):
        ends, words = split_words(texts)
        facts = [_facts(w) for w in words.dictionary.to_pylist()]
        index = np.asarray(words.indices, np.int64)
        column = lambda i, kind: np.fromiter((f[i] for f in facts), kind, len(facts))[index] if len(index) else np.empty(0, kind)
        code, kind, closes, name = column(0, np.uint64), column(1, np.int8), column(2, bool), column(3, bool)
        first = ends[:-1][ends[:-1] < len(code)]
        opens = np.ones(len(code), bool)
        opens[1:] = closes[:-1]
        opens[first] = True
        full = kind != EMPTY
        kept = np.concatenate([[0], np.cumsum(full)])
        self.ends, code, kind, opens, name = kept[ends], code[full], kind[full], opens[full], name[full]
        counted = np.zeros(len(code), bool)
        counted[1:] = kind[:-1] == NUMBER
        counted[self.ends[:-1][self.ends[:-1] < len(code)]] = False
        value = np.zeros(len(code), np.uint64)
        value[kind == NUMBER] = _PLACE["num"]
        value[(kind == UNIT) & counted] = _PLACE["unit"]
        value[kind == MEASURE] = _PLACE["measure"]
        by_place = np.where((kind == CAPITAL) & ~opens, np.uint64(_PLACE["name"]), value)
        by_word = np.where(name, np.uint64(_PLACE["name"]), value)
        places = [np.zeros(len(code), np.uint64), by_place, by_word]
        self.rolls = [Rolling(np.where(p > 0, p, code)) for p in places]
        slot = code | np.uint64(1)
        self.slots = np.stack([np.where(by_place + by_word > 0, slot, np.uint64(0)), *[np.where(p > 0, slot, np.uint64(0)) for p in places[1:]]])
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        self.places, self.names, self.parts = total(by_place > 0), total(by_word > 0), total(by_place != by_word)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in all tokens, variant, hash and whether the template by place has enough words, of each window as it
        is and of its templates that have slots and enough words."""
        n = np.maximum(np.diff(self.ends) - size + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        at = self.ends[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        most = size - min(LITERALS, size)
        places, names, parts = (c[at + size] - c[at] for c in (self.places, self.names, self.parts))
        rich = places <= most
        use = [np.arange(len(at)), np.flatnonzero(rich & (places > 0)), np.flatnonzero((names <= most) & (names > 0) & (parts > 0))]
        hashes = np.concatenate([roll.of(at[i], at[i] + size) for roll, i in zip(self.rolls, use)])
        variant, use = np.repeat(np.arange(len(use)), [len(i) for i in use]), np.concatenate(use)
        return text[use], at[use], variant, hashes, rich[use]


def _slot_lists(t: Templates, at: np.ndarray, variant: np.ndarray, size: int) -> pa.Array:
    values = t.slots[variant[:, None], at[:, None] + np.arange(size)]
    return pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * size).astype(np.int32)), pa.array(signed(values.ravel())))


_WINDOW_SCHEMA = "hash long, at int, slots array<long>"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, windows (how many the item has), worded (how many have enough words), rich (whether this one has), hash,
    at, slots. An item shorter than a window is one window."""

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                t = Templates(batch.column("text")[lo:hi])
                n = np.diff(t.ends)
                for size in sorted({min(window, x) for x in n.tolist() if x >= 2}):
                    text, at, variant, hashes, rich = t.windows(size)
                    mine = np.minimum(n[text], window) == size
                    text, at, variant, hashes, rich = text[mine], at[mine], variant[mine], hashes[mine], rich[mine]
                    worded = np.bincount(text[rich & (variant == PLAIN)], minlength=len(n))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(text + lo)), pa.array(np.full(len(text), size, np.int32)), *[pa.array(c[text].astype(np.int32)) for c in (n - size + 1, worded)], pa.array(rich), pa.array(signed(hashes)), pa.array((at - t.ends[text]).astype(np.int32)), _slot_lists(t, at, variant, size)],
                        ["item_id", "size", "windows", "worded", "rich", "hash", "at", "slots"],
                    )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(scan, f"item_id long, size int, windows int, worded int, rich boolean, {_WINDOW_SCHEMA}"), "items")


def _judge(long_run: int):
    """Of each diagonal: places of the windows that count, whether they make a long run, whether all slots kept their values.

    The slots of a diagonal give each value of the item the value that most of its places have in the document. A window
    counts unless a slot of it has a value met less often than that one; windows with equal slots always count.
    """

    def judge(batches):
        for batch in batches:
            found, size = batch.column("found"), np.asarray(batch.column("size"), np.int64)
            windows, many = found.flatten(), np.diff(np.asarray(found.offsets, np.int64))
            diagonal = np.repeat(np.arange(batch.num_rows), many)
            place = np.asarray(windows.field("place"), np.int64)
            own, doc = (np.asarray(windows.field(c).flatten(), np.int64) for c in ("own", "slots"))
            doc = np.where(doc == 0, own, doc)  # equal words, of which one alone is a slot for what stands around it
            window = np.repeat(np.arange(len(place)), size[diagonal])
            position = np.arange(len(own)) - (np.cumsum(size[diagonal]) - size[diagonal])[window] + place[window]
            slots = pd.DataFrame({"diagonal": diagonal[window], "window": window, "position": position, "own": own, "doc": doc})[own != 0]
            votes = slots.drop_duplicates(["diagonal", "position", "own", "doc"]).groupby(["diagonal", "own", "doc"], as_index=False).size()
            votes["less"] = votes["size"] < votes.groupby(["diagonal", "own"])["size"].transform("max")
            slots = slots.merge(votes, on=["diagonal", "own", "doc"])
            against, changed = np.zeros(len(place), bool), np.zeros(len(place), bool)
            against[slots["window"][slots["less"]]] = True
            changed[slots["window"][slots["own"] != slots["doc"]]] = True
            verbatim = np.ones(batch.num_rows, bool)
            verbatim[diagonal[changed]] = False
            counted = pd.DataFrame({"diagonal": diagonal, "place": place, "rich": np.asarray(windows.field("rich"))})[~(against & changed)].drop_duplicates().sort_values(["diagonal", "place"])
            d, at = counted["diagonal"].to_numpy(), counted["place"].to_numpy()
            breaks = np.ones(len(d), bool)
            breaks[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)
            length, first = np.bincount(np.cumsum(breaks) - 1), d[breaks]
            run = np.zeros(batch.num_rows, bool)
            run[first[length >= np.maximum(long_run - size[first] + 1, 1)]] = True
            ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=batch.num_rows))])
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32)))
            rich = counted["rich"].to_numpy()
            rich_ends = np.concatenate([[0], np.cumsum(np.bincount(d[rich], minlength=batch.num_rows))])
            rich_places = pa.ListArray.from_arrays(pa.array(rich_ends.astype(np.int32)), pa.array(at[rich].astype(np.int32)))
            names = ["doc_id", "text_hash", "item_id", "windows", "worded"]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], places, rich_places, pa.array(run), pa.array(verbatim)], [*names, "places", "rich_places", "run", "verbatim"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return judge


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, long_run: int = 20, window: int = WINDOW) -> DataFrame:
    """One row per document and item that it leaks: doc_id, text_hash, item_id, coverage, n_windows, verbatim.

    An item leaks if windows that count match at least `least` of its windows or of those with enough words, or windows over
    `long_run` of its tokens in a row; coverage is the larger share. Windows with fewer words match word for word only.
    A diagonal's slots are consistent if each value of the item has become one value of the document; different values of the
    item may have become the same one (a leak all the same), and one value may not have become two. verbatim tells that all
    slots kept their values. Null and empty texts leak nothing and items of one word are never
    leaked; null ids are ordinary values; repeated rows give one result per doc_id and text. Of values that a diagonal gives a
    slot equally often, each counts (a tie drops nothing). A text is taken whole, however long; empty tables give no rows;
    other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    items = item_windows(benchmark, window)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` numbers
    spots = items.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).cast("int").alias("h")).distinct().toPandas()["h"].to_numpy()
    known = np.zeros(FILTER_BITS, bool)
    known[spots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known))

    def scan(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                t = Templates(batch.column("text")[lo:hi])
                for size in sizes:
                    text, at, variant, hashes, _ = t.windows(size)
                    hit = known[hashes & np.uint64(FILTER_BITS - 1)]
                    text, at, variant, hashes = text[hit], at[hit], variant[hit], hashes[hit]
                    take = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(np.full(len(text), size, np.int32)), pa.array(signed(hashes)), pa.array((at - t.ends[text]).astype(np.int32)), _slot_lists(t, at, variant, size)],
                        ["doc_id", "text_hash", "size", "hash", "at", "slots"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(scan, f"doc_id long, text_hash long, size int, {_WINDOW_SCHEMA}")
    met = found.join(items.select("size", "hash", "item_id", "windows", "worded", "rich", F.col("at").alias("place"), F.col("slots").alias("own")), ["size", "hash"])
    diagonal = ["doc_id", "text_hash", "item_id", "delta"]
    met = met.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("place")).alias("delta"), "windows", "worded", "size", F.struct("place", "rich", "own", "slots").alias("window"))
    by = met.groupBy(*diagonal).agg(F.first("windows").alias("windows"), F.first("worded").alias("worded"), F.first("size").alias("size"), F.collect_set("window").alias("found"))
    by = by.mapInArrow(_judge(long_run), "doc_id long, text_hash long, item_id long, windows int, worded int, places array<int>, rich_places array<int>, run boolean, verbatim boolean")
    per_item = by.groupBy("doc_id", "text_hash", "item_id").agg(
        F.first("windows").alias("windows"), F.first("worded").alias("worded"), *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for c, n in (("places", "matched"), ("rich_places", "rich"))], F.bool_or("run").alias("run"), F.bool_and("verbatim").alias("verbatim")
    )
    share = F.greatest(F.col("matched") / F.col("windows"), F.when(F.col("worded") > 0, F.col("rich") / F.col("worded")))
    return per_item.where((share >= least) | F.col("run")).select("doc_id", "text_hash", "item_id", F.round(share, 6).alias("coverage"), F.col("matched").cast("long").alias("n_windows"), "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    doc, hash_ = (apart(docs) + c for c in ("doc", "hash"))
    bad = leaks(docs, benchmark, **how).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(doc), F.col("text_hash").alias(hash_)).distinct()
    bad = broadcast_if_small(stored(bad, "leaks"), BROADCAST_ROWS)
    return docs.join(bad, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
