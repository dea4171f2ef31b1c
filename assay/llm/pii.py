"""PII: surrogate generation by column expressions.

Each detected entity has a type and a normal form; equal normal forms are one entity,
wherever and however they are written.  An entity's surrogate is drawn from a keyed hash
of type, normal form and attempt.  Attempt 0 needs no look at other rows, so it is made
where the text is read.  Surrogates that would collide, with each other or with a real
entity, are found by aggregation over the distinct entities; the later ones try again
until none collide.  Only these few are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .secrets import _one, spans

# Titles and the gender they tell.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "господин", "κύριος", "պարոն", "ბატონი", "מר", "السيد", "श्री", "นาย")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "госпожа", "κυρία", "տիկին", "ქალბატონი", "גברת", "السيدة", "श्रीमती", "นางสาว")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
# Letters of surrogate names by script (consonants, vowels), and name endings by gender.
SCRIPTS = {
    "latin": ("b d f g l m n r s t v w z k p h", "a e i o u", ("n", "na", "r")),
    "cyrillic": ("б д ф г л м н р с т в з к п ж ш", "а е и о у", ("н", "на", "р")),
    "greek": ("β δ φ γ λ μ ν ρ σ τ ζ κ π θ χ ξ", "α ε ι ο υ", ("νος", "να", "ρη")),
    "armenian": ("բ դ ֆ գ լ մ ն ր ս տ վ զ կ պ հ շ", "ա ե ի ո ու", ("ն", "նա", "ր")),
    "georgian": ("ბ დ ფ გ ლ მ ნ რ ს ტ ვ ზ კ პ ჰ შ", "ა ე ი ო უ", ("ნ", "ნა", "რ")),
    "hebrew": ("ב ד פ ג ל מ נ ר ס ט ו ז כ ק ה ש", "א ע י ו ה", ("ן", "נה", "ר")),
    "arabic": ("ب د ف ج ل م ن ر س ط و ز ك ق ه ش", "ا و ي ع ة", ("ن", "نة", "ر")),
    "devanagari": ("ब द फ ग ल म न र स त व ज क प ह श", "ा े ि ो ु", ("न", "ना", "र")),
    "thai": ("บ ด ฟ ก ล ม น ร ส ต ว ซ ค ป ห ช", "า ี ู ะ ิ", ("น", "นา", "ร")),
    "hangul": ("가 나 다 라 마 바 사 자 차 카 타 파 하 고 노 도", "김 민 선 준 현", ("준", "희", "영")),
    "hiragana": ("か さ た な は ま や ら き し に み り こ そ と", "あ い う え お", ("た", "こ", "み")),
    "katakana": ("カ サ タ ナ ハ マ ヤ ラ キ シ ニ ミ リ コ ソ ト", "ア イ ウ エ オ", ("タ", "コ", "ミ")),
    "han": ("王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林", "安 文 明 国 海", ("伟", "芳", "平")),
}
#: What tells a script, in this order: a kana beside Han characters makes a name Japanese.
TOLD = {k: rf"\p{{Is{k.capitalize()}}}" for k in SCRIPTS if k != "latin"}
NAME = rf"(?U)(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}])(?<!\w)(?:(?:{TITLES})\.?\x20)+[\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]+(?:\x20\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)?"
# Fixed value: phones with no country, (555) 123-4567 or 555-123-4567, and after a 0, 030 1234567.
NATIONAL = r"(?=[(0-9])(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:(?:1[ .-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9A-Za-z]|[ .-][0-9])"
TYPES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("ip", r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?=[0-9])(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"(?=\+)(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|" + NATIONAL),
    ("name", NAME),
)


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"(?U)^((?:(?:{TITLES})\.?\x20)+)", 1)


def normal(kind: Column, match: Column) -> Column:
    """What makes two mentions the same entity; of names with gender and script."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    name = F.substr(match, F.length(_title(match)) + 1)
    told = {k: _title(match).rlike(rf"(?U)(?<!\w)(?:{'|'.join(some)})(?!\w)") for k, some in (("f", FEMALE), ("m", MALE))}
    gender = F.when(told["f"], "f").when(told["m"], "m").otherwise("n")
    script = F.lit("latin")
    for kind_of, letter in reversed(TOLD.items()):
        script = F.when(name.rlike(letter), kind_of).otherwise(script)
    return (
        F.when(kind == "email", F.lower(match)).when(kind == "ip", match)
        .when(kind == "name", F.concat_ws("|", gender, script, F.lower(name)))
        .otherwise(digits)
    )


def _number(hash_: Column, at: int, size: int) -> Column:
    return F.conv(F.substr(hash_, F.lit(at), F.lit(size)), 16, 10).cast("long")


def luhn(digits: Column) -> Column:
    """Whether the last digit of a string of digits is its Luhn check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), step) % 10 == 0)


def _checked(body: Column) -> Column:
    """``body`` with the Luhn check digit after it."""
    tens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
    return F.element_at(F.filter(tens, luhn), 1)


def surrogate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """The surrogate's own normal form: same type, length, validity, gender and script.

    Later attempts have more room: each adds a syllable to a name, every fourth a digit to a
    phone number, up to 8 of both.
    """
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string")), 256)
    stream = F.concat(*[F.lpad((_number(h, 1 + 15 * i, 15) % 10**18).cast("string"), 18, "0") for i in range(2)])
    n = F.length(form)
    email = F.concat(F.translate(F.substr(h, F.lit(1), F.lit(12)), "0123456789", "ghijklmnop"), F.lit("@mail"), F.pmod(_number(h, 20, 4), F.lit(10)).cast("string"), F.lit(".example.org"))
    # the first octet avoids 0, 10, 127 and 224 and above
    first = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(223)), lambda x: ~x.isin(10, 127)), (F.pmod(_number(h, 1, 6), F.lit(221)) + 1).cast("int"))
    octets = [F.pmod(_number(h, 7 + 6 * i, 6), F.lit(256)).cast("string") for i in range(2)] + [F.pmod(_number(h, 19, 6), F.lit(254) + 0).cast("int") + 1]
    ip = F.concat_ws(".", first.cast("string"), *[o.cast("string") for o in octets])
    plain = F.substr(stream, F.lit(1), n)
    longer = F.substr(stream, F.lit(3), n - 2 + F.least(F.floor(attempt / 4), F.lit(8)).cast("int"))
    nonzero = F.concat((F.substr(plain, F.lit(1), F.lit(1)).cast("int") % 8 + 2).cast("string"), F.substr(plain, F.lit(2)))
    card = F.when(luhn(form), _checked(F.substr(nonzero, F.lit(1), n - 1))).otherwise(
        F.when(luhn(nonzero), F.concat(F.substr(nonzero, F.lit(1), n - 1), ((F.substr(nonzero, n, F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(nonzero)
    )
    # the country's digit and the area's first digit (2 to 9) keep a phone number plausible
    phone = F.concat(F.substr(form, F.lit(1), F.lit(1)), (F.substr(plain, F.lit(2), F.lit(1)).cast("int") % 8 + 2).cast("string"), longer)
    ssn = F.concat(F.lit("9"), F.substr(plain, F.lit(2)))
    gender, script = F.element_at(F.split(form, r"\|"), 1), F.element_at(F.split(form, r"\|"), 2)
    syllables = ends = F.lit(None).cast("string")
    for kind_of, (consonants, vowels, ending) in SCRIPTS.items():
        syllables = F.when(script == kind_of, " ".join(c + v for c in consonants.split() for v in vowels.split())).otherwise(syllables)
        ends = F.when(script == kind_of, " ".join(ending)).otherwise(ends)
    end = F.element_at(F.split(ends, " "), F.when(gender == "m", 1).when(gender == "f", 2).otherwise(3))

    def made(list_: Column) -> Column:
        part = [F.element_at(list_, (F.pmod(_number(h, 1 + 4 * i, 4), F.size(list_)) + 1).cast("int")) for i in range(16)]
        first_word = F.array_join(F.slice(F.array(*part[:11]), F.lit(1), F.least(attempt, F.lit(8)) + 3), "")
        two = F.when(F.element_at(F.split(form, r"\|"), 3).contains(" "), F.concat(F.lit(" "), F.initcap(F.concat(*part[11:])))).otherwise("")
        return F.concat(F.initcap(first_word), end, two)

    names = F.when(kind == "name", _one(F.split(syllables, " "), made))
    names = F.concat_ws("|", gender, script, F.lower(names))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(names)


def render(kind: Column, match: Column, form: Column) -> Column:
    """The surrogate's form written as the mention was: separators, case and title."""
    before = F.transform(F.split(match, ""), lambda c: c)
    filled = F.aggregate(
        before, F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], F.substr(form, acc["i"] + 1, F.lit(1))).alias("out")))
        .otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: F.concat(acc["out"], F.when(kind == "phone", F.substr(form, acc["i"] + 1)).otherwise("")),
    )
    name = F.initcap(F.element_at(F.split(form, r"\|"), 3))
    old = F.substr(match, F.length(_title(match)) + 1)
    name = F.when(old == F.upper(old), F.upper(name)).otherwise(name)
    email = F.when(match == F.upper(match), F.upper(form)).otherwise(form)
    return F.when(kind == "email", email).when(kind == "ip", form).when(kind == "name", F.concat(_title(match), name)).otherwise(filled)


ENTITIES = "array<struct<start:int,end:int,kind:string,match:string,form:string>>"


def _detected(docs: DataFrame) -> DataFrame:
    """(id, row, t, entities): a number of the row, the input's columns as one struct, so that no
    name of theirs can clash, the text and its entities."""
    t = F.col("t")
    step = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    # what every match holds; most texts have neither and aren't searched further
    step = step.withColumn("digits", t.rlike("[0-9]{2}"))
    needs = {"email": t.contains("@"), "name": F.lit(True)}
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    step = step.withColumns({kind: F.when(needs.get(kind, F.col("digits")), spans(t, pattern)).otherwise(empty) for kind, pattern in TYPES})

    def labelled(order: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))

    step = step.select("id", "row", "t", F.concat(*[labelled(i, kind) for i, (kind, _) in enumerate(TYPES)]).alias("found"))
    first = F.filter("found", lambda s: ~F.exists("found", lambda o: (o["order"] < s["order"]) & (o["start"] < s["end"]) & (s["start"] < o["end"])))
    full = F.transform(F.array_sort(first), lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], normal(s["kind"], s["match"]).alias("form")))
    return step.select("id", "row", "t", F.when(F.size("found") > 0, full).otherwise(F.array().cast(ENTITIES)).alias("entities"))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``entities``: array of (start, end, kind, match, form), by start.

    Where mentions overlap, the type listed first in TYPES has it.  Null and empty texts have
    none; repeated rows have the same.  Other columns keep their values, whatever their names;
    one named ``entities`` is replaced.  An empty table stays empty.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "entities"]
    return _detected(docs).select(*kept, "entities")


def retries(entities: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(kind, form, own) of the entities whose surrogate isn't that of attempt 0.

    ``entities``: distinct kind and form.  In each round an entity keeps its surrogate if
    no real entity has it, no settled one took it, and it is the smallest that asks for it.
    """
    real = table(entities, "entities")
    asking = real.select("kind", "form", F.lit(0).alias("attempt"))
    settled: DataFrame | None = None
    for _ in range(rounds):
        made = table(asking.withColumn("own", surrogate(key, F.col("kind"), F.col("form"), F.col("attempt"))), "asking")
        taken = real.select("kind", F.col("form").alias("own"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "own"))
        claims = made.select("kind", "own", F.col("form"), F.lit(1).alias("n")).unionByName(taken.select("kind", "own", F.lit(None).cast("string").alias("form"), F.lit(2).alias("n")))
        crowded = claims.groupBy("kind", "own").agg(F.sum("n").alias("n"), F.min("form").alias("first"), F.max("n").alias("top")).filter("n > 1 and first is not null")
        crowded = table(crowded.select(F.col("kind").alias("k"), F.col("own").alias("o"), F.when(F.col("top") == 1, F.col("first")).alias("first")), "crowded")
        clash = (F.col("kind") == F.col("k")) & (F.col("own") == F.col("o")) & ~F.col("form").eqNullSafe(F.col("first"))
        again = table(made.join(crowded, clash, "left_semi").select("kind", "form", "attempt"), "again")
        good = made.join(again.select(F.col("kind").alias("k"), F.col("form").alias("f")), (F.col("kind") == F.col("k")) & (F.col("form") == F.col("f")), "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        if not again.head(1):
            return settled.filter("attempt > 0").select("kind", "form", "own")
        asking = again.withColumn("attempt", F.col("attempt") + 1)
    raise RuntimeError("too many collisions: the space of surrogates is too small")


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities`` (replaced in it).

    The same key gives the same surrogates; equal entities have equal ones, different
    entities different ones, and none is an entity of the corpus.  Null texts stay null,
    with 0 entities; repeated rows change alike; a column named n_entities is replaced; an
    empty table stays empty; other columns are kept as they are.
    """
    rows = table(_detected(docs).drop("t"), "detected")  # texts are searched once, and rows keep their numbers
    some = rows.filter(F.size("entities") > 0)
    pair = F.transform("entities", lambda e: F.struct(e["kind"].alias("kind"), e["form"].alias("form")))
    found = some.select(F.explode(F.array_distinct(pair)).alias("e")).select("e.kind", "e.form").distinct()
    changed = table(retries(found, key), "retries")
    if changed.head(1):
        # per row that holds one: the entities that try again, a small part of all
        small = some.select("id", F.explode(F.array_distinct(pair)).alias("e")).select("id", F.col("e.kind").alias("k"), F.col("e.form").alias("f"))
        hits = small.join(changed, (F.col("k") == F.col("kind")) & (F.col("f") == F.col("form")))
        hits = hits.groupBy(F.col("id").alias("hit")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "form"), "own"))).alias("own"))
        rows = rows.join(table(hits, "rows-that-try-again"), F.col("id") == F.col("hit"), "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("map<string,string>"))
    t = F.coalesce("row.text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        form = F.coalesce(F.try_element_at("own", F.concat_ws("|", e["kind"], e["form"])), surrogate(key, e["kind"], e["form"], F.lit(0)))
        out = F.concat(acc["out"], F.substr(t, acc["at"] + 1, e["start"] - acc["at"]), render(e["kind"], e["match"], form))
        return F.struct(e["end"].alias("at"), out.alias("out"))

    clean = F.aggregate("entities", start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    new = {"text": F.when(F.size("entities") > 0, clean).otherwise(F.col("row.text"))}
    kept = [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c != "n_entities"]
    return rows.select(*kept, F.size("entities").cast("long").alias("n_entities"))
