"""Personal data: surrogate generation with DataFrame functions only.

Emails, phone and card numbers, addresses of machines, account and national
numbers, secrets and titled names are found by patterns. Each distinct entity of
the corpus gets one keyed surrogate of its type: digits for digits, letters for
letters in the same script and case, names by the title's gender; separators stay
as each occurrence has them, but IPv6 addresses are written out in full. Secrets
have no upper length. A document's titled names are replaced without their title,
too, and a family name alone gets that of the document's one full name with it. Surrogates that meet each other or a real entity
are drawn again, so distinct entities stay distinct, and equal ones stay equal
across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames

#: Session setting that holds the key of the registered query and the pipeline; without it, they use one for public test data.
KEY_SETTING, TEST_KEY = "spark.anchorite.surrogateKey", "anchorite-surrogates"
#: Draws for an entity whose surrogates collide; from half of them on, surrogates are longer.
MAX_DRAWS = 12

#: Kinds and their patterns, in order of precedence.
FEMALE, MALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Г-жа|Госпожа", "Mr|Herr|Monsieur|Señor|Sr|Signor|Г-н|Господин"
TITLE = rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE}|Dr|Prof)\.? "
#: A part of a name, also of the forms McDonald and O'Brien.
WORD = r"(?:\p{Lu}['’](?=\p{Lu}))?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*"
#: Country codes of one, two and three digits.
COUNTRY = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
GROUP, IP = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Addresses with '::' for groups of zeros, by the number of groups before it.
SHORT = "|".join([*(rf"(?:{GROUP}:){{{i}}}(?:(?::{GROUP}){{0,{6 - i}}}:(?:{IP}|{GROUP})|:)" for i in range(1, 7)), rf"(?:{GROUP}:){{7}}:", rf":(?::{GROUP}){{0,6}}:(?:{IP}|{GROUP})"])
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+(?<![\-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?<=[:=\s\"'])(?=[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{7})(?<=(?i:token|secret|password|passwd|api[_\-]?key)\s{0,2}[:=]\s{0,2}[\"']?)[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{7,}(?<!\.)|[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs)_[A-Za-z0-9]{30,}+|(?:sk|pk|rk)[\-_][A-Za-z0-9_\-]{16,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}(?![A-Za-z0-9:])",
    "ipv6": rf"(?<![A-Za-z0-9:])(?=[0-9A-Fa-f]{{0,4}}:)(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{6}}{IP}|{SHORT})(?![A-Za-z0-9:])",
    "ip": rf"(?<![0-9.]){IP}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": r"(?=\p{Lu})" + TITLE + rf"{WORD}(?:[ \-]{WORD}){{0,2}}",
}
#: Only the kinds that begin with a digit may begin right after a letter, so most places of a text are passed over at once.
PATTERN = r"(?:(?<![A-Za-z])|(?=[0-9]))(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"

#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("f", "latin"): "Alice Bruna Clara Diana Elena Flora Greta Helga Irene Julia Karin Laura Maria Norah Olivia Paula".split(),
    ("m", "latin"): "Albert Bruno Conrad David Edgar Felix Gregor Henry Ivan Jonas Kaspar Leon Martin Nolan Oscar Peter".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Матвей Олег".split(),
}
SYLLABLES = {"latin": "bar cor den fal gor hal jen kel lor mar nor pel ran sel tor vin".split(), "cyrillic": "бар вол гор дан зим кор лев мир нов пет рад сок тор фед чер шум".split()}


def hint(text: Column) -> Column:
    """Whether a text may hold an entity: each of them has one of these, which are found faster than it."""
    keyed = r"[:=](?<=(?i:token|secret|password|passwd|api[_\-]?key)\s{0,2}[:=])"
    initials = "".join(sorted({t[0] for t in f"{FEMALE}|{MALE}|Dr|Prof".split("|")}))
    return (
        text.rlike("[0-9@]")
        | text.contains("::")
        | text.rlike(r"[\-_](?<=(?:[spr]k|gh[pos])[\-_])")
        | ((text.contains(":") | text.contains("=")) & text.rlike(keyed))
        | text.rlike(rf"(?=[{initials}]){TITLE}\p{{Lu}}")
        | text.rlike(r"[A-Fa-f]{32}|(?:[A-Fa-f]{1,4}[:\-]){5}|A[KS]IA[A-Z]{16}")
    )


def kind_of(raw: Column) -> Column:
    out = F
    for kind, p in KINDS.items():
        out = out.when(raw.rlike(f"^(?:{p})$"), F.lit(kind))
    # A secret known by what stands before it, or a match that its neighbours decided.
    return out.otherwise(F.lit("secret"))


def bare_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "^" + TITLE, "")


def in_full(raw: Column) -> Column:
    """All 32 digits of an IPv6 address."""
    v4 = F.regexp_extract(raw, rf"(?<=:)({IP})$", 1)
    octets = F.transform(F.split(v4, "\\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0"))
    tail = F.concat(F.get(octets, 0), F.get(octets, 1), F.lit(":"), F.get(octets, 2), F.get(octets, 3))
    plain = F.when(v4 != "", F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(v4)), tail)).otherwise(raw)
    halves = F.split(plain, "::", -1)
    left, right = (F.transform(F.filter(F.split(F.coalesce(F.get(halves, i), F.lit("")), ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0")) for i in (0, 1))
    digits = F.array_join(left, ""), F.array_join(right, "")
    return F.lower(F.concat(digits[0], F.repeat(F.lit("0"), F.lit(32) - F.length(digits[0]) - F.length(digits[1])), digits[1]))


def canonical(kind: Column, raw: Column) -> Column:
    """The entity that an occurrence names: without separators and case (a secret as it stands), for names without the title."""
    return (
        F.when(kind == "name", F.lower(bare_name(raw)))
        .when(kind == "secret", raw)
        .when(kind.isin("email", "ip"), F.lower(raw))
        .when(kind == "ipv6", in_full(raw))
        .otherwise(F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", "")))
    )


def detail(kind: Column, raw: Column) -> Column:
    """What a surrogate must keep: a name's gender and script, a number's country code."""
    gender = F.when(raw.rlike(rf"^(?:{FEMALE})\b"), "f").when(raw.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")
    script = F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.when(kind == "name", F.concat_ws(":", gender, script)).when(kind == "phone", F.regexp_extract(F.regexp_replace(raw, "[^0-9+]", ""), COUNTRY, 1)).when(kind == "iban", F.lower(F.substring(raw, 1, 2))).otherwise("")


def kept(kind: Column, keep: Column) -> Column:
    """What all occurrences of one entity keep, as an aggregate: the gender that its titles agree on, the longest code."""
    f, m = (F.coalesce(F.max(keep.startswith(g)), F.lit(False)) for g in ("f:", "m:"))
    gender = F.when(f & ~m, "f").when(m & ~f, "m").otherwise("n")
    return F.when(F.first(kind) == "name", F.concat_ws(":", gender, F.min(F.substring_index(keep, ":", -1)))).otherwise(F.max_by(keep, F.struct(F.length(keep), keep)))


def family(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def titled(name: Column) -> Column:
    """Capitals after spaces and hyphens."""
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def repeats(names: Column) -> Column:
    """A pattern of a document's names (without titles) and their family names, the longest first; null without names."""
    forms = F.array_distinct(F.concat(names, F.transform(names, family)))
    ordered = F.array_sort(forms, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def byte(digest: Column, i: Column) -> Column:
    """The i-th of a digest's 64 bytes, cyclically, as a number."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letters(text: Column, digest: Column, first: Column, hexadecimal: Column) -> Column:
    """Keyed digits for digits and letters for letters, from position ``first`` on; other characters stay."""
    chars = F.split(text, "")
    alphabet = F.when(hexadecimal, F.lit("abcdef")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))

    def one(c: Column, i: Column) -> Column:
        b = byte(digest, i)
        return (
            F.when(i < first, c)
            .when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), F.pmod(b, F.lit(10)) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(alphabet, F.pmod(b, F.length(alphabet)) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int") + 1)


def surrogate(kind: Column, entity: Column, keep: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of an entity at a draw; a name keeps its number of parts, with their spaces and hyphens."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, keep, entity, draw.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f")), 256))
    at = lambda i: byte(digest, F.lit(i))
    octets = F.concat_ws(".", *[(at(i) if i else at(i) % 223 + 1).cast("string") for i in range(4)])
    more = F.when(draw > MAX_DRAWS // 2, 3).when(draw > 0, 1).otherwise(0)

    def family_of(words: list[str], i: Column) -> Column:
        return F.concat(*[pick(words, byte(digest, i + k)) for k in range(3)], *[F.when(more > k, pick(words, byte(digest, i + 3 + k))).otherwise("") for k in range(3)])

    def name_of(given: list[str], words: list[str]) -> Column:
        spaced = F.split(entity, " ")

        def part(w: Column, i: Column) -> Column:
            def half(_: Column, j: Column) -> Column:
                return F.when(i == F.size(spaced) - 1, family_of(words, 1 + j * 6)).otherwise(pick(given, byte(digest, i * 17 + j * 5)))

            return F.array_join(F.transform(F.split(w, "-"), half), "-")

        return F.array_join(F.transform(spaced, part), " ")

    name = F
    for script, words in SYLLABLES.items():
        for gender in "fmn":
            given = GIVEN["f", script] + GIVEN["m", script] if gender == "n" else GIVEN[gender, script]
            name = name.when(keep == f"{gender}:{script}", name_of(given, words))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    longer = F.when(draw > MAX_DRAWS // 2, F.lower(F.substring(digest, F.lit(100), F.lit(8)))).otherwise("")
    no = F.lit(False)
    mail = F.concat(letters(local, digest, F.lit(0), no), longer, F.lit("@"), letters(host, F.reverse(digest), F.lit(0), no), top)
    low = F.lower(entity)
    other = letters(low, digest, F.length(keep), kind.isin("secret", "mac", "ipv6") & low.rlike("^[0-9a-f]+$"))
    return F.when(kind == "name", F.lower(name.otherwise(F.lit("")))).when(kind == "email", mail).when(kind == "ip", octets).otherwise(other)


def in_format(kind: Column, raw: Column, sub: Column) -> Column:
    """A surrogate in the form of one occurrence: its separators, its case, its title."""
    chars = F.split(raw, "")
    # Place of each letter or digit among those of the occurrence.
    places = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("n"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct((acc.n + 1).alias("n"), F.concat(acc.out, F.when(c.rlike("[A-Z]"), F.upper(F.substring(sub, acc.n, F.lit(1)))).otherwise(F.substring(sub, acc.n, F.lit(1)))).alias("out")),
        ).otherwise(F.struct(acc.n.alias("n"), F.concat(acc.out, c).alias("out"))),
        lambda acc: acc.out,
    )
    # A secret may be long, and its surrogate has its separators already: letter by letter, without counting.
    cased = F.array_join(F.zip_with(chars, F.split(sub, ""), lambda c, x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x)), "")
    whole = F.regexp_replace(sub, "(.{4})(?!$)", "$1:")
    shouted = raw.rlike("[A-Z]") & ~raw.rlike("[a-z]")
    return F.when(kind == "name", F.concat(F.regexp_extract(raw, "^(" + TITLE + ")", 1), titled(F.when(bare_name(raw).contains(" "), sub).otherwise(family(sub))))).when(kind.isin("email", "ip"), F.when(shouted, F.upper(sub)).otherwise(sub)).when(kind == "secret", cased).when(kind == "ipv6", F.when(shouted, F.upper(whole)).otherwise(whole)).otherwise(places)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, keep, entity, sub) of distinct entities (kind, keep, entity): surrogates that collide with another or with an entity are drawn again.

    An error tells of entities whose surrogates still collide after the last draw: none is given out that is not distinct.
    """
    now = entities.withColumn("draw", F.lit(0)).withColumn("sub", surrogate(F.col("kind"), F.col("entity"), F.col("keep"), F.col("draw"), key))
    now = frames.stored(now, "surrogates")
    real = now.select(F.col("kind").alias("k"), F.lower("entity").alias("e")).distinct()
    for _ in range(MAX_DRAWS):
        # The one drawn first keeps its surrogate, so a kept one is never taken away.
        rank = F.row_number().over(Window.partitionBy("kind", "sub").orderBy("draw", "entity", "keep"))
        marked = now.withColumn("rank", rank).join(real, (F.col("kind") == F.col("k")) & (F.col("sub") == F.col("e")), "left")
        again = (F.col("rank") > 1) | F.col("e").isNotNull()
        draw = F.when(again, F.col("draw") + 1).otherwise(F.col("draw"))
        after = marked.select("kind", "keep", "entity", again.alias("again"), draw.alias("draw"), F.col("sub").alias("old"))
        after = frames.stored(after.withColumn("sub", F.when(F.col("again"), surrogate(F.col("kind"), F.col("entity"), F.col("keep"), F.col("draw"), key)).otherwise(F.col("old"))), "surrogates")
        now = after.drop("again", "old")
        if after.where("again").limit(1).count() == 0:
            return now.select("kind", "keep", "entity", "sub")
    raise RuntimeError(f"{after.where('again').count()} entities have no distinct surrogate after {MAX_DRAWS} draws")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with surrogates in the text, and a column pii_count (replaced if there is one).

    Surrogates follow from the key, which must be kept as secret as the data: who has it can test guesses.

    Null and empty texts stay as they are, with count 0. Repeated rows give
    repeated rows with the same surrogates; other columns pass through untouched,
    whatever their names. An empty input gives no rows.
    """
    columns = [c for c in docs.columns if c != "pii_count"]
    rows = docs.select(F.struct(*columns).alias("row"))
    text = F.col("row").getField(text_col)
    found = F.when(hint(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    has = F.size(F.coalesce("found", F.array())) > 0
    # Only documents with entities are written down; the rest passes straight through.
    marked = rows.withColumn("found", found).where(has).withColumn("names", F.array_distinct(F.transform(F.filter("found", lambda x: x.rlike("^" + TITLE)), bare_name)))
    # Documents with names are searched again for repeats of these without a title.
    marked = marked.withColumn("pattern", F.concat(F.lit(PATTERN + "|"), repeats(F.col("names"))))
    marked = marked.withColumn("found", F.when(F.col("pattern").isNull(), F.col("found")).otherwise(F.regexp_extract_all(text, F.col("pattern"), F.lit(0))))
    marked = frames.stored(marked.withColumn("uid", F.monotonically_increasing_id()), "pii")
    one = marked.select("uid", "names", F.posexplode("found").alias("pos", "raw")).withColumn("bare", bare_name(F.col("raw")))
    is_name = F.exists("names", lambda n: (n == F.col("bare")) | (family(n) == F.col("bare")))
    one = one.withColumn("kind", F.when(is_name, "name").otherwise(kind_of(F.col("raw"))))
    # A family name alone stands for the one full name of its document that has it.
    full = F.filter("names", lambda n: n.contains(" ") & (family(n) == F.col("bare")))
    entity = F.when(is_name & (F.size(full) == 1), F.lower(F.get(full, 0))).otherwise(canonical(F.col("kind"), F.col("raw")))
    one = one.withColumn("entity", entity).withColumn("keep", detail(F.col("kind"), F.col("raw"))).drop("names", "bare")
    one = frames.stored(one, "occurrences")
    subs = dictionary(one.groupBy("kind", "entity").agg(kept(F.col("kind"), F.col("keep")).alias("keep")), key).drop("keep")
    done = one.join(subs, ["kind", "entity"]).select("uid", F.struct("pos", in_format(F.col("kind"), F.col("raw"), F.col("sub")).alias("sub")).alias("x"))
    done = done.groupBy("uid").agg(F.array_sort(F.collect_list("x")).getField("sub").alias("subs"))
    pieces = F.when(F.col("pattern").isNull(), F.split(text, PATTERN, -1)).otherwise(F.split(text, F.col("pattern"), -1))
    joined = F.array_join(F.flatten(F.zip_with(pieces, "subs", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = marked.join(done, "uid").select("row", joined.alias("text"), F.size("subs").alias("n"))
    same = rows.withColumn("found", found).where(~has).select("row", text.alias("text"), F.lit(0).alias("n"))
    out = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
    return changed.union(same).select(*out, F.col("n").cast("long").alias("pii_count"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), session_key(spark)).select("doc_id", "text", "pii_count")
