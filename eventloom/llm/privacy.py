"""Personal data, and terms that give it away.

Patterns find addresses, numbers and cards. What stands beside them may still
reveal them: a name that always comes with one address discloses it. The corpus
tells how strongly. With P(e) the share of documents that hold an entity e, and
P(e|t) that share among the documents with term t, a term discloses

    log(P(e|t) / P(e)) / -log P(e)        (1: the term implies the entity)

Terms above a first threshold are generalised, above a second one removed.
Terms are all words of a document outside its entities. A few texts are no
estimate: a term must be in SUPPORT different texts with the entity, and the lower
confidence bound of P(e|t), over different texts, must reach the share at which a
term is generalised, or one half. In a document that holds the entity, every place
of a disclosing term is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import whole_text
from eventloom.llm.spans import Kind, apart, joined, replaced, with_matches
from eventloom.session import materialise

#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.85, 0.97
#: Different texts in which term and entity must stand together.
SUPPORT = 3
#: Standard deviations by which the share of an entity among a term's texts is
#: lowered (95 % one-sided), and the share that is enough, whatever the threshold.
DEVIATIONS, ENOUGH = 1.645, 0.5
#: Bits of the map of candidate terms that spares counting other words.
MAP_BITS = 1 << 20

_WORD = r"[\p{L}\p{N}]+"
#: Stands for an entity while words are read, so that what touches one is no word.
_HOLE = "\ue000"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Every second digit from the right doubled; the sum of all digits ends in 0."""
    backwards = F.reverse(_digits(value))

    def part(i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.length(backwards))
    return F.aggregate(places, F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _card(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when(n.between(13, 19), _luhn(value)).otherwise(F.lit(False))


def _ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(number) > 3, False).otherwise(
            F.coalesce(number.try_cast("int"), F.lit(0)) <= 255
        )

    return F.forall(F.split(value, r"\."), small)


# Attempts begin where a run of letters or digits does, or where the last match
# ended: further inside a run they fail alike. This keeps long runs linear.
_EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
)
_ADDRESS = r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"

KINDS = [
    Kind("email", _EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    Kind("ip", _ADDRESS, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), _card
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda m: F.length(_digits(m)).between(9, 15),
    ),
]
BASE = [k.name for k in KINDS]
TERM = "term"


def with_entities(docs: DataFrame) -> DataFrame:
    """The rows with `base`, the spans of all kinds, by kind as listed, then by start.

    Expects a `text` without missing values.
    """
    df = docs
    for kind in KINDS:
        df = with_matches(df, "text", kind, f"base_{kind.name}")
    names = [f"base_{k.name}" for k in KINDS]
    return df.withColumn("base", F.concat(*names)).drop(*names)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", whole_text()).withColumn("text_key", F.xxhash64("text"))


def entities(docs: DataFrame) -> DataFrame:
    """`doc_id, text_key, base, held` of every row, written once; `held` is the text if it has entities."""
    spans = F.transform(
        "base",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.when(s["kind"] == "email", F.lower(s["value"]))
            .when(s["kind"] == "ip", s["value"])
            .otherwise(_digits(s["value"]))
            .alias("value"),
        ),
    )
    found = with_entities(_keyed(docs.select("doc_id", "text")))
    held = F.when(F.size("base") > 0, F.col("text"))
    return materialise(found.select("doc_id", "text_key", spans.alias("base"), held.alias("held")))


def _held_texts(found: DataFrame) -> DataFrame:
    """`text_key, held, base, words` for every different text with entities.

    `words` are the different ones, lower-cased, that no span touches.
    """
    holes = F.array_sort(
        F.transform(
            "base",
            lambda s: F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"), F.lit(_HOLE).alias("mark")
            ),
        )
    )
    texts = found.where("held is not null").select("text_key", "held", "base").dropDuplicates(["text_key"])
    texts = texts.withColumn("cut", replaced("held", holes))
    words = F.regexp_extract_all(F.lower("cut"), F.lit(rf"[\p{{L}}\p{{N}}{_HOLE}]+"), F.lit(0))
    words = F.filter(F.array_distinct(words), lambda w: ~w.contains(_HOLE))
    return texts.select("text_key", "held", "base", words.alias("words"))


def _marked(rows: DataFrame) -> DataFrame:
    """`word, bits`: a map of MAP_BITS bits with those of the rows' terms set, 64 to a row.

    A table, not a constant: a constant of this size would be written out in every
    description of every plan that holds it.
    """
    return (
        rows.select(_slot().alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    )


def _on_map(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose `term` shares a bit with one that the map was made of."""
    # MAP_BITS / 64 rows at most, whatever the input, so the map goes to every task.
    known = rows.withColumn("slot", _slot()).join(F.broadcast(marks), F.expr("slot div 64 = word"))
    hit = F.getbit("bits", F.expr("cast(slot % 64 as int)")) == 1
    return known.where(hit).drop("slot", "word", "bits")


def _slot() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(MAP_BITS))


def _shared_entities(found: DataFrame, n: float) -> DataFrame:
    """`text_key, entity, copies, n_entity` for entities that are in several different texts.

    `copies` are the rows with that text. An entity of all documents says nothing.
    """
    names = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"]))
    held = (
        found.where(F.size("base") > 0)
        .select("text_key", F.explode(F.array_distinct(names)).alias("entity"))
        .groupBy("text_key", "entity")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    named = held.groupBy("entity").agg(
        F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts")
    )
    named = named.where((F.col("texts") >= SUPPORT) & (F.col("n_entity") < n))
    return materialise(held.join(named.drop("texts"), "entity"))


def _lower_bound(share: Column, texts: Column) -> Column:
    """Wilson's lower confidence bound of a share that was seen in `texts` texts."""
    z2 = DEVIATIONS**2
    spread = DEVIATIONS * F.sqrt(share * (1 - share) / texts + z2 / (4 * texts * texts))
    return (share + z2 / (2 * texts) - spread) / (1 + z2 / texts)


def disclosing_terms(docs: DataFrame, words: DataFrame, shared: DataFrame, n: float) -> DataFrame | None:
    """`entity, term, action`: what discloses an entity, and whether it is generalised or removed.

    Shares are over all `n` documents. `words` has `text_key, copies, entities, term`
    for the texts with shared entities; `entities` are (entity, n_entity). None if no
    term has support.
    """
    # A term is in as many documents as it is in with shared entities, at least. It can
    # reach the threshold for an entity only if these are not too many for the
    # entity's own number, so common words never meet the entities of a text.
    room = lambda n_entity: n_entity * F.exp(F.log(F.lit(n) / n_entity) * (1 - GENERALISE))
    widest = shared.agg(F.max(room(F.col("n_entity")))).first()[0] or 0.0
    seen = (
        words.groupBy("term")
        .agg(F.sum("copies").alias("n_seen"), F.count(F.lit(1)).alias("texts"))
        .where((F.col("texts") >= SUPPORT) & (F.col("n_seen") <= widest))
        .drop("texts")
    )
    near = F.filter("entities", lambda e: room(e["n_entity"]) >= F.col("n_seen"))
    known = F.log(F.lit(n) / F.col("n_entity"))
    most = F.col("n_both") * F.exp(known * (1 - GENERALISE))
    candidates = materialise(
        words.join(seen, "term")
        .select(F.explode(near).alias("e"), "term", "copies", "n_seen")
        .groupBy("e.entity", "e.n_entity", "term", "n_seen")
        .agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts"))
        .where((F.col("texts") >= SUPPORT) & (F.col("n_seen") <= most))
    )
    if candidates.isEmpty():
        return None
    # Words that no candidate shares a bit with are not counted.
    different = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    alone = docs.select(whole_text().alias("text")).select(F.explode(different).alias("term"))
    alone = _on_map(alone, _marked(candidates)).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term")
    )
    gained = F.log(F.col("n_both") * F.lit(n) / (F.col("n_term") * F.col("n_entity")))
    # Copies say nothing more: the bound is that of the different texts.
    share = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    least = F.least(F.exp(-known * (1 - GENERALISE)), F.lit(ENOUGH))
    return materialise(
        candidates.join(alone, "term")
        .where(_lower_bound(share, F.col("texts") / share) >= least)
        .withColumn("disclosed", gained / known)
        .where(F.col("disclosed") >= GENERALISE)
        .select(
            "entity",
            "term",
            F.when(F.col("disclosed") >= REMOVE, "remove").otherwise("generalise").alias("action"),
        )
    )


def with_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`key_text, terms` for the different texts that have disclosing terms.

    `terms` are spans (kind 'term', start, stop, action), by start: every place
    of a term that discloses an entity of the text.
    """
    n = float(found.count())
    shared = _shared_entities(found, n)
    lists = shared.groupBy("text_key").agg(
        F.collect_list(F.struct("entity", "n_entity")).alias("entities"),
        F.first("copies").alias("copies"),
    )
    texts = materialise(_held_texts(found).join(lists, "text_key"))
    words = texts.select("text_key", "copies", "entities", F.explode("words").alias("term"))
    disclosing = disclosing_terms(docs, words, shared, n)
    if disclosing is None:
        return found.sparkSession.createDataFrame(
            [], "key_text bigint, terms array<struct<kind:string,start:bigint,stop:bigint,action:string>>"
        )
    marks = _marked(disclosing)
    # A word that discloses two entities counts once, by the stronger action.
    hits = (
        _on_map(words, marks)
        .select("text_key", "term", F.explode("entities.entity").alias("entity"))
        .join(disclosing, ["entity", "term"])
        .groupBy("text_key", "term")
        .agg(F.max("action").alias("action"))
    )
    place = Kind(TERM, _WORD, lambda t: F.lit(True), lambda m: F.lit(True))
    marked = texts.join(hits.select("text_key").distinct(), "text_key", "left_semi")
    placed = with_matches(marked, "held", place, "places").select(
        "text_key", F.explode(apart(F.col("places"), F.col("base"))).alias("place")
    )
    # Places are joined with the words, not looked up in a list of them, which a
    # long text would walk once per place.
    placed = _on_map(placed.withColumn("term", F.lower("place.value")), marks)
    spans = F.array_sort(
        F.collect_list(F.struct("place.start", "place.stop", "place.kind", "action"))
    )
    return (
        placed.join(hits, ["text_key", "term"])
        .groupBy(F.col("text_key").alias("key_text"))
        .agg(
            F.transform(
                spans, lambda w: F.struct(w["kind"], w["start"], w["stop"], w["action"])
            ).alias("terms")
        )
    )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["text_key"] == right["key_text"]


def find_private(docs: DataFrame) -> DataFrame:
    """`doc_id`, counts `n_email, n_ip, n_card, n_phone`, `base_sha256`, `spans` for every row.

    `spans` lists base spans by kind, then start, and after them the disclosing
    terms by start. Missing texts count as empty and have no spans. Rows with
    equal id and text have equal results. Other columns are not read.
    """
    found = entities(docs)
    terms = with_terms(docs, found)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    listed = joined(F.col("base"))
    added = joined(F.coalesce("terms", F.array()))
    return found.join(terms, _same(found, terms), "left").select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(listed, F.lit("")), F.nullif(added, F.lit(""))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with private spans replaced, all columns kept.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE], generalised terms [TERM];
    removed terms go. Overlapping spans leave one mark. A missing text stays
    missing; `n_chars`, where it is a column, is set to the new length.
    """
    own = docs.columns
    terms = with_terms(docs, entities(docs))
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.col("doc_id"),
        whole_text().alias("text"),
    )
    wide = with_entities(wide.withColumn("text_key", F.xxhash64("text")))
    spans = F.array_sort(
        F.concat(
            F.transform(
                "base",
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["stop"].alias("stop"),
                    F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"),
                ),
            ),
            F.transform(
                F.coalesce("terms", F.array()),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["stop"].alias("stop"),
                    F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("mark"),
                ),
            ),
        )
    )
    clean = wide.join(terms, _same(wide, terms), "left").withColumn("spans", spans)
    clean = clean.withColumn("clean", replaced("text", F.col("spans")))
    text = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col("row.n_chars")) if "n_chars" in own else None}
    return clean.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in own])
