"""Language identification by Bayesian fusion of text, markup, address and host.

For every language ``l``

    P(l | row)  ~  P(text | l) ** temper * P(declared | l) * P(l | host)

* ``P(text | l)``: hashed letter trigrams, counted over all rows that declare a
  language, in one grouped aggregation;
* ``P(declared | l)``: how often rows whose text alone says ``l`` declare it,
  counted over all rows, so that it carries as much weight as declarations deserve;
* ``P(l | host)``: the text verdicts of the host's other rows, smoothed by those
  of its domain, these by those of its address suffix, these by all rows.

``und`` (undetermined) competes as one more language in which every trigram is
equally likely. A row is accepted if the winner is a language, has at least
``least`` of the probability, and the text has a letter at all.

Declared languages count by their primary tag of two or three letters; a
three-letter code of a language that has a two-letter one is that. Tags that name
no language (``und``, ``mul``, ``mis``, ``zxx``) and longer words count as not
declared. A model has ``BINS`` numbers for each language that occurs.

Defined cases: null and empty texts have no letters: they are never accepted,
their language is ``und`` with probability null. A null host takes no part in
any host's counts and gets the prior of all rows. With no declared language at
all every row is ``und``. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from .rows import map_rows

BINS = 1 << 14
#: Trigrams overlap: three of them are about one piece of evidence.
TEMPER = 1 / 3
#: Rows that a level of the host's address is trusted like, against the level above.
TRUST = 5.0
UND = "und"
# fixed values: tags that name no language, and the three-letter codes of each two-letter one
NO_LANGUAGE = ["und", "mul", "mis", "zxx"]
CODES = """aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze ba:bak be:bel bg:bul bi:bis
bm:bam bn:ben bo:bod,tib br:bre bs:bos ca:cat ce:che ch:cha co:cos cr:cre cs:ces,cze cu:chu cv:chv cy:cym,wel da:dan
de:deu,ger dv:div dz:dzo ee:ewe el:ell,gre en:eng eo:epo es:spa et:est eu:eus,baq fa:fas,per ff:ful fi:fin fj:fij
fo:fao fr:fra,fre fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau he:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun
hy:hye,arm hz:her ia:ina id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl,ice it:ita iu:iku ja:jpn jv:jav ka:kat,geo
kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug
li:lim ln:lin lo:lao lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri,mao mk:mkd,mac ml:mal mn:mon mr:mar ms:msa,may mt:mlt
my:mya,bur na:nau nb:nob nd:nde ne:nep ng:ndo nl:nld,dut nn:nno no:nor nr:nbl nv:nav ny:nya oc:oci oj:oji om:orm or:ori
os:oss pa:pan pi:pli pl:pol ps:pus pt:por qu:que rm:roh rn:run ro:ron,rum ru:rus rw:kin sa:san sc:srd sd:snd se:sme
sg:sag sh:hbs si:sin sk:slk,slo sl:slv sm:smo sn:sna so:som sq:sqi,alb sr:srp ss:ssw st:sot su:sun sv:swe sw:swa ta:tam
te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi ty:tah ug:uig uk:ukr ur:urd uz:uzb
ve:ven vi:vie vo:vol wa:wln wo:wol xh:xho yi:yid yo:yor za:zha zh:zho,chi zu:zul"""

_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)
_HIDDEN = re.compile(r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible_text(markup: str | None) -> str:
    """The text of a page without markup, scripts, styles and navigation."""
    return html.unescape(_HIDDEN.sub(" ", markup or ""))


def trigrams(text: str) -> np.ndarray:
    """The bins of all trigrams around a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    middle = codes[1:-1] != 32
    mixed = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) \
        + codes[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    return (mixed[middle] >> np.uint32(18)).astype(np.int64)


def primary_tag(declared: Column) -> Column:
    tag = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    pairs = [pair.split(":") for pair in CODES.split()]
    names = F.create_map(*[F.lit(x) for two, threes in pairs for three in threes.split(",")
                           for x in (three, two)])
    return F.when((tag != "") & ~tag.isin(NO_LANGUAGE), F.coalesce(F.try_element_at(names, tag), tag))


def markup_language(markup: Column) -> Column:
    return primary_tag(F.regexp_extract(
        markup, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z][A-Za-z_-]*)""", 1))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


@dataclass(frozen=True)
class TextModel:
    """Log-likelihoods, one row of ``BINS`` a language, and a last one for ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray

    def log_likelihoods(self, text: str) -> tuple[list[float], int]:
        bins = trigrams(text)
        if len(bins) < BINS:
            sums = self.table[:, bins].sum(axis=1, dtype=np.float64)
        else:
            sums = self.table @ np.bincount(bins, minlength=BINS).astype(np.float64)
        return sums.tolist(), len(bins)


def learn(rows: DataFrame, text_col: str, declared_col: str, markup: bool) -> TextModel:
    """Trigram counts of all rows by declared language."""
    rows = rows.filter(F.col(declared_col).isNotNull()).select(text_col, declared_col)

    def run(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py() or ""
                bins = trigrams(visible_text(text) if markup else text)
                if language not in counts:
                    counts[language] = np.zeros(BINS, dtype=np.int64)
                counts[language] += np.bincount(bins, minlength=BINS)
        for language, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(found[at])], names=["language", "bin", "n"])

    counts = rows.mapInArrow(run, "language string, bin int, n long")
    # BINS numbers for each declared language that occurs
    counts = counts.groupBy("language", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["language"].unique()))
    table = np.full((len(languages) + 1, BINS), 0.5)
    for i, language in enumerate(languages):
        mine = counts[counts["language"] == language]
        table[i, mine["bin"].to_numpy()] += mine["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def read_texts(rows: DataFrame, model: TextModel, text_col: str, markup: bool,
               keep: list[str]) -> DataFrame:
    """``keep`` and evidence (log-likelihoods by language, und last), letters, verdict (an index)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def do(rows):
            out = []
            for (text,) in rows:
                sums, letters = model.log_likelihoods(
                    visible_text(text) if markup else text or "")
                out.append((sums, letters, int(np.argmax(sums)) if letters else None))
            return out

        return do

    return map_rows(rows, [text_col], "evidence array<double>, letters long, verdict int", work, keep)


def _counts(rows: DataFrame, level: str, size: int) -> DataFrame:
    """(level, n_<level>): text verdicts by class, an array."""
    sums = [F.sum((F.col("verdict") == i).cast("long")) for i in range(size)]
    known = rows.filter(F.col(level).isNotNull() & F.col("verdict").isNotNull())
    return known.groupBy(level).agg(F.array(*sums).alias(f"n_{level}"))


def identify(rows: DataFrame, text_col: str, declared_col: str, host_col: str,
             markup: bool = False, keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``keep`` and language, probability, declared, host, text_language, accepted of every row."""
    keep = rows.columns if keep is None else keep
    labelled = rows.select(
        F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text_col).alias("text"),
        F.col(declared_col).alias("declared"), F.col(host_col).alias("host"))
    model = learn(labelled, "text", "declared", markup)
    size = len(model.languages) + 1
    read = checkpointed(read_texts(labelled, model, "text", markup, ["kept", "declared", "host"]))
    read = read.withColumns({
        "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})

    # one small table with a row a host; a host with very many rows is one key
    # with one row on this side, so adaptive execution splits the other side
    hosts = _counts(read, "host", size)
    hosts = hosts.withColumns({
        "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    for level in ("domain", "suffix"):
        per_level = hosts.groupBy(level).agg(F.array(*[
            F.sum(F.col("n_host")[i]) for i in range(size)]).alias(f"n_{level}"))
        hosts = hosts.join(per_level, level)
    hosts = hosts.select("host", "n_host", "n_domain", "n_suffix")
    joined = read.drop("domain", "suffix").join(hosts, "host", "left")

    known = read.filter(F.col("verdict").isNotNull())
    pairs = known.groupBy("verdict", "declared").agg(F.count(F.lit(1)).alias("n")).collect()
    names = [*model.languages, UND]
    place = {name: i for i, name in enumerate(names)}
    confusion = np.ones((size, size))
    total = np.ones(size)
    for r in pairs:
        total[r["verdict"]] += r["n"]
        if r["declared"] in place:
            confusion[r["verdict"], place[r["declared"]]] += r["n"]
    declared = np.log(confusion / confusion.sum(axis=1, keepdims=True))
    all_rows = total / total.sum()

    def numbers(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    # the row's own verdict is no evidence about its host
    own = F.coalesce(F.col("verdict"), F.lit(-1))

    def smoothed(counts: Column, above: Column) -> Column:
        others = F.transform(counts, lambda n, i: (n - (i == own).cast("long")).cast("double"))
        sums = F.aggregate(others, F.lit(0.0), lambda a, n: a + n)
        level = F.zip_with(others, above, lambda n, p: (n + TRUST * p) / (sums + TRUST))
        return F.coalesce(level, above)

    scores = joined.withColumn("_suffix", smoothed(F.col("n_suffix"), numbers(all_rows)))
    scores = scores.withColumn("_domain", smoothed(F.col("n_domain"), F.col("_suffix")))
    scores = scores.withColumn("_prior", smoothed(F.col("n_host"), F.col("_domain")))
    # a row a language, as a literal would grow with the square of their number
    says = rows.sparkSession.createDataFrame(
        [(name, declared[:, i].tolist()) for i, name in enumerate(names[:-1])],
        "declared string, _says array<double>")
    scores = scores.join(F.broadcast(says), "declared", "left")
    said = F.coalesce(F.col("_says"), numbers([0.0] * size))
    logs = F.zip_with(F.col("evidence"), F.zip_with(said, "_prior", lambda d, p: d + F.log(p)),
                      lambda e, d: e * TEMPER + d)
    scores = scores.withColumn("_logs", logs).withColumn("_most", F.array_max("_logs"))
    mass = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most")))
    at = F.array_position("_logs", F.col("_most")).cast("int")
    has = F.col("letters") > 0
    language = F.when(has, F.element_at(F.array(*map(F.lit, names)), at)).otherwise(F.lit(UND))
    share = F.when(has, 1 / mass)
    said_text = F.when(has, F.get(F.array(*map(F.lit, names)), F.col("verdict"))).otherwise(F.lit(UND))
    result = scores.select(
        "kept", language.alias("language"), share.alias("probability"), "declared", "host",
        said_text.alias("text_language"))
    accepted = (F.col("language") != UND) & (F.coalesce("probability", F.lit(0.0)) >= least)
    return result.select("kept.*", "language", "probability", "declared", "host", "text_language",
                         accepted.alias("accepted"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Languages of web pages: markup declares, the address has host and suffix."""
    rows = pages.select(
        "page_id", F.col("html").alias("text"), markup_language(F.col("html")).alias("declared"),
        host_of(F.col("url")).alias("host"))
    return identify(rows, "text", "declared", "host", markup=True, keep=["page_id"])


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, unchanged; a source stands for the host."""
    # all that a verdict depends on: rows that agree in the key have one verdict.
    # A hash leaves nulls out, so it is told where they are.
    judged = ["doc_id", "text", "lang", "source"]
    told = [*judged, *[F.col(c).isNull() for c in judged]]
    key = F.concat(F.hex(F.xxhash64(*told)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *told)))
    rows = docs.select(key.alias("key"), "text", primary_tag(F.col("lang")).alias("declared"),
                       F.col("source").alias("host"))
    rejected = identify(rows, "text", "declared", "host", keep=["key"]).filter(~F.col("accepted"))
    # Written first: a few rejected rows are then known to be few, and the texts
    # are not shuffled to leave them out.
    rejected = stored(rejected.select("key").distinct(), "rejected")
    # packed, so that no column of the documents is taken for one of these
    packed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return packed.join(rejected, "key", "left_anti").select("row.*")
