"""Line dedup by a log-template tree, in DataFrame functions alone.

The tree has a fixed depth: a line goes by its number of tokens, then by its first
LEADING tokens, to a leaf. Tokens with a digit are variable fields from the start
(`<*>`). Two lines of a leaf are of one template if they agree in SIMILARITY of their
places, which makes the others' places variable, or if such lines link them; a leaf
holds as many templates as it takes. Two lines that may differ in d places share one of
d + 1 segments of them. A segment's lines are compared with CENTERS of them; where that
leaves lines of one segment in several components, any of them may still agree. If they
are few (FEW for each of the d + 1) they are compared with each other; else the places
beside that segment are parted into d + 1 segments again, LEVELS times in all, since
long lines that share most of their segments would multiply with each. Whatever lines
are in open segments even then go by the d + 1 places of theirs whose words are rarest
in the leaf, of which two lines of one template share one: they are compared with
CENTERS of those that share one, at last with all of another component. So no link is
lost, and none but lines of several components that share a rare place multiply.
Components of the links are the templates.

A template is recurring if documents of at least MIN_DOCUMENTS kinds have it. Texts
are of one kind if their lines (by tokens, each template once) are of a Jaccard
similarity of RELATED or more, or if such texts link them: exact and near copies
repeat each other's lines, and finding them is near-dedup's work. The rarest template
that two such texts share has in both what weighs RELATED of the text from it on, in
order of frequency; texts that share such a one are compared with CENTERS of them, and
where that leaves several components, with all of another one for which both have
enough from it on. Lines of recurring templates are dropped from every document,
so all lines of a block that recurs go, wherever it stands.

Names of texts, lines and templates are 60 bits of MD5; everything is counted by
those and summed before it shuffles, so a line in any share of the rows is a row
for each task. Tables go to every task only if they have few rows.

Defined results: a null text stays null and has no lines; blank lines are kept,
count for nothing; repeated rows are changed alike; no rows give no rows; a document
whose lines all go keeps its row with an empty text; input columns n_lines, n_dropped,
__text_id, __gone and __lines are replaced or left out, further columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.functions.columns import computed
from concord.llm._common import columns, few, forget, written
from concord.llm.near_dup import components

LEADING, SIMILARITY, CENTERS, MIN_DOCUMENTS = 3, 0.8, 3, 3
FEW, LEVELS = 4, 2
#: Nodes of a key that meet all others of it in one part.
SIDE = 500
RELATED = 0.5
#: White space within a line.
BLANKS = " \t\r\x0b\x0c"
#: A prime, and a generator whose powers give it its orders of names.
PRIME, GENERATOR = 2147483647, 48271
#: A line's weight has this many bits: one of more tokens weighs as if it had no more.
WEIGHT_BITS = 16
MOST_TOKENS = (1 << WEIGHT_BITS) - 1


def name_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def order_of(name: Column | str, k: int) -> Column:
    """A name's place in the k-th order."""
    return F.pmod(F.pmod(F.col(name) if isinstance(name, str) else name, F.lit(PRIME)) * F.lit(pow(GENERATOR, k + 1, PRIME)), F.lit(PRIME))


def normal(text: Column) -> Column:
    """The text with one blank between the tokens of a line and none around them."""
    one = F.regexp_replace(F.regexp_replace(text, f"[{BLANKS}]+", " "), " ?\n ?", "\n")
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for x in ("  ", " \n", "\n ", *BLANKS[1:]):
        odd = odd | F.contains(text, F.lit(x))
    return F.when(odd, F.trim(one)).otherwise(text)


def masked(line: Column) -> Column:
    """A normal line with `<*>` for each token with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def line_rows(docs: DataFrame, leading: int) -> DataFrame:
    """text_id, pos, name, leaf, tokens and line (masked) of every line that isn't blank."""
    own = computed(docs.filter("text is not null").select("text"), text_id=name_of(F.col("text")), text=normal(F.col("text")))
    raw = own.select("text_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = raw.filter("raw <> ''").select("text_id", "pos", masked(F.col("raw")).alias("line"))
    tokens = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("text_id", "pos", name_of(F.col("line")).alias("name"), F.xxhash64(tokens, F.substring_index("line", " ", leading)).alias("leaf"), F.least(tokens, F.lit(MOST_TOKENS)).alias("tokens"), "line")


def allowed(tokens: Column, similarity: float) -> Column:
    """Places in which lines of one template may differ."""
    return F.floor(tokens * (1 - similarity) + 1e-9).cast("int")


def middle_ones(keyed: DataFrame, keys: list[str], node: str, centers: int) -> DataFrame:
    """keys and c0, c1 ...: the first node of each key with several, in as many orders."""
    return keyed.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(F.struct(order_of(node, k).alias("o"), node)).alias(f"c{k}") for k in range(centers)]).filter("n > 1").select(*keys, *[F.col(f"c{k}.{node}").alias(f"c{k}") for k in range(centers)])


def met(keyed: DataFrame, keys: list[str], node: str, centers: int) -> DataFrame:
    """x and y: each node with the middle ones of its keys, once each."""
    pairs = keyed.join(middle_ones(keyed, keys, node, centers), keys).select(node, F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(centers)]))).alias("center")).filter(F.col(node) != F.col("center"))
    return pairs.select(F.least(node, "center").alias("x"), F.greatest(node, "center").alias("y")).distinct()


def part(words: Column, i: Column, d: Column) -> tuple[Column, Column]:
    """The i-th of d + 1 parts of an array, and all others."""
    begin, end = (F.floor(k * F.size(words) / (d + 1) + 1e-9).cast("int") for k in (i, i + 1))
    return F.slice(words, begin + 1, end - begin), F.concat(F.slice(words, F.lit(1), begin), F.slice(words, end + 1, F.size(words)))


def templates(lines: DataFrame, leading: int, similarity: float, centers: int) -> DataFrame:
    """node (name) and component (its template) of the lines that belong to a template of several."""
    some = lines.filter(allowed(F.col("tokens"), similarity) > 0)
    several = written(some.groupBy("leaf", "name").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf"), "line-leaves")
    own = some.select("leaf", "name", "line").join(few(several), "leaf", "left_semi").groupBy("leaf", "name", "line").agg(F.lit(1).alias("one"))
    own = written(own.select("leaf", "name", F.split("line", " ").alias("words")), "line-variants")
    d, free = allowed(F.size("words"), similarity), F.slice("words", F.lit(leading + 1), F.size("words"))
    words = lambda n, w: own.select(F.col("name").alias(n), F.col("words").alias(w))  # noqa: E731
    differ = F.aggregate(F.zip_with("a", "b", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    alike = differ <= allowed(F.size("a"), similarity)
    linked = lambda pairs: written(pairs.join(words("x", "a"), "x").join(words("y", "b"), "y").filter(alike).select("x", "y"), "line-links")  # noqa: E731
    # name, the segment that its lines share, and which of the d + 1 it was each time
    open_ = own.select("name", "words", F.col("leaf").alias("key"), F.array().cast("array<int>").alias("path"))
    links, labels, old, left = [], None, [], None
    for level in range(LEVELS):
        rest = computed(open_.select("name", "key", "path", d.alias("d"), free.alias("free")), rest=F.aggregate("path", F.col("free"), lambda r, i: part(r, i, F.col("d"))[1]))
        shared = lambda i: F.struct(F.xxhash64("key", i, part(F.col("rest"), i, F.col("d"))[0]).alias("key"), F.concat("path", F.array(i)).alias("path"))  # noqa: E731
        keyed = written(rest.select("name", "d", F.inline(F.transform(F.sequence(F.lit(0), F.col("d")), shared))), "line-segments")
        links.append(linked(met(keyed, ["key"], "name", centers)))
        forget(*[t for t in (labels, *old) if t is not None])
        labels = components(reduce(DataFrame.unionByName, links))
        again = written(unsettled(keyed, labels, "name").withColumn("few", FEW * (F.col("d") + 1)), "line-again")
        old = [again]
        forget(keyed)
        if again.isEmpty():
            break
        few_ = again.filter("n <= few")
        sides = [few_.select("key", F.col("name").alias(x), F.col("component").alias(c)) for x, c in (("x", "p"), ("y", "q"))]
        links.append(linked(sides[0].join(sides[1], "key").filter("x < y and p <> q").select("x", "y").distinct()))
        many = again.filter("n > few")
        if level == LEVELS - 1 or many.isEmpty():
            forget(labels)
            labels = components(reduce(DataFrame.unionByName, links))
            left = many.select("name").distinct()
            break
        open_ = many.join(own.select("name", "words"), "name")
    if left is not None and not left.isEmpty():
        keyed = written(rare_places(own.join(left, "name", "left_semi").select("name", "leaf", d.alias("d"), free.alias("free"))), "line-places")
        links.append(linked(met(keyed, ["key"], "name", centers)))
        forget(labels)
        labels = components(reduce(DataFrame.unionByName, links))
        open_ = written(unsettled(keyed, labels, "name"), "line-open-places")
        old += [keyed, open_]
        if not open_.isEmpty():
            pairs = across(open_.join(own.select("name", "words"), "name").select("key", "n", "component", F.col("name").alias("x"), F.col("words").alias("a")), {"x": "y", "a": "b"})
            links.append(written(pairs.filter(alike).select("x", "y").distinct(), "line-links"))
            forget(labels)
            labels = components(reduce(DataFrame.unionByName, links))
    forget(several, own, *old, *links)
    return labels


def rare_places(rows: DataFrame) -> DataFrame:
    """name and key: a line's d + 1 rarest places with their words; two lines of a leaf that differ in d places at most share one of them."""
    places = rows.select("name", "d", F.explode(F.transform("free", lambda w, i: F.xxhash64("leaf", i, w))).alias("key"))
    often = places.groupBy("key").agg(F.count("*").alias("often"))
    ordered = F.array_sort(F.collect_list(F.struct("often", "key")))
    return places.join(often, "key").groupBy("name", "d").agg(ordered.alias("all")).select("name", F.explode(F.slice("all", F.lit(1), F.col("d") + 1)).alias("p")).select("name", "p.key")


def unsettled(keyed: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """keyed's rows of the keys whose nodes are of several components and may not all have been compared, with component and n, how many a key has."""
    named = keyed.join(few(labels).withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    left = named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    return named.join(left.filter((F.col("n") > 2) & (F.col("least") != F.col("most"))).select("key", "n"), "key")


def across(rows: DataFrame, other: dict[str, str], side: int = SIDE) -> DataFrame:
    """Every pair x < y of a key's nodes of two components, with the columns of both (other names those of y).

    A key of many nodes is parted: each node is in one part as x and in all as y, so
    no task holds a key, and pairs are never rows before they are tested.
    """
    parts = F.ceil(F.col("n") / side).cast("int")
    one = rows.withColumn("part", F.pmod(F.xxhash64("x"), parts).cast("int")).drop("n")
    two = rows.select("key", F.col("component").alias("__other"), *[F.col(c).alias(n) for c, n in other.items()], F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return one.join(two, ["key", "part"]).filter("x < y and component <> __other")


def kinds(own: DataFrame, shared: DataFrame, related: float, centers: int) -> DataFrame:
    """node (text_id) and component of the texts that others of their kind link; own has text_id, template and tokens once each, shared the templates of several texts."""
    told = own.join(few(shared).select("template", F.lit(True).alias("__s")), "template", "left")
    sizes = told.groupBy("text_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("__s"), F.col("tokens")).otherwise(0)).alias("common"))
    # a text is of no other's kind if what it shares with all of them is too little
    open_ = written(sizes.filter(F.col("common") >= related * F.col("tokens")).select("text_id", "tokens"), "line-open")
    rows = own.drop("tokens").join(few(open_), "text_id").join(few(shared), "template")
    # a template's tokens are as many in every text, so they fit into the low bits of its name
    code = F.col("template").bitwiseAND(F.lit(-65536)).bitwiseOR(F.col("size").cast("long"))
    # texts of that similarity have in common what weighs related of each, so the rarest template that they share has as much from it on in both
    upto = F.sum("size").over(Window.partitionBy("text_id").orderBy(F.col("n").desc(), F.col("template").desc()))
    told = written(rows.groupBy("text_id", "tokens").agg(F.collect_list(code).alias("codes")), "line-texts")
    keyed = written(rows.withColumn("upto", upto).filter(F.col("upto") >= related * F.col("tokens") - 1e-6).select("text_id", "tokens", F.col("template").alias("key"), "upto"), "line-rare")
    both = F.aggregate(F.array_intersect("a", "b"), F.lit(0).cast("long"), lambda t, x: t + x.bitwiseAND(F.lit(65535)))
    near = lambda t: t.withColumn("both", both).filter(F.col("both") >= related * (F.col("l") + F.col("m") - F.col("both"))).select("x", "y").distinct()  # noqa: E731
    sides = [told.select(F.col("text_id").alias(x), F.col("codes").alias(c), F.col("tokens").alias(m)) for x, c, m in (("x", "a", "l"), ("y", "b", "m"))]
    links = [written(near(met(keyed, ["key"], "text_id", centers).join(sides[0], "x").join(sides[1], "y")), "line-kin")]
    labels = components(links[0])
    left = written(unsettled(keyed, labels, "text_id"), "line-open-kin")
    if not left.isEmpty():
        told_left = left.drop("tokens").join(told, "text_id").select("key", "n", "component", F.col("text_id").alias("x"), F.col("codes").alias("a"), F.col("tokens").alias("l"), F.col("upto").alias("u"))
        pairs = across(told_left, {"x": "y", "a": "b", "l": "m", "u": "v"})
        # what two texts have in common from a template on is no more than either has
        pairs = pairs.filter(F.least("u", "v") * (1 + related) >= related * (F.col("l") + F.col("m")) - 1e-6)
        links.append(written(near(pairs), "line-kin"))
        forget(labels)
        labels = components(reduce(DataFrame.unionByName, links))
    forget(open_, told, keyed, left, *links)
    return labels


def recurring(named: DataFrame, min_documents: int, related: float, centers: int) -> DataFrame:
    """The templates that recur."""
    own = written(named.groupBy("text_id", "template").agg(F.max("tokens").alias("tokens")), "line-owners")
    shared = written(own.groupBy("template").agg(F.count("*").alias("n"), F.max("tokens").alias("size")).filter("n > 1"), "line-shared")
    labels = kinds(own, shared, related, centers)
    often = own.join(few(shared).filter(F.col("n") >= min_documents), "template", "left_semi").join(few(labels).withColumnRenamed("node", "text_id"), "text_id", "left")
    # one row a template and kind before they are counted, so that a template in all texts is no single task's
    once = often.select("template", F.coalesce("component", "text_id").alias("kind")).groupBy("template", "kind").agg(F.lit(1).alias("one"))
    found = written(once.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("template"), "line-recurring")
    forget(own, shared, labels)
    return found


def dedup_lines(docs: DataFrame, leading: int = LEADING, similarity: float = SIMILARITY, centers: int = CENTERS, min_documents: int = MIN_DOCUMENTS, related: float = RELATED) -> DataFrame:
    """docs with the lines of recurring templates taken out of text, with n_lines (not blank) and n_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "__text_id", "__gone", "__lines")])
    lines = written(line_rows(columns(docs, "text"), leading), "lines")
    labels = templates(lines, leading, similarity, centers)
    own = lines.select("text_id", "pos", "name", "tokens").join(few(labels).withColumnRenamed("node", "name"), "name", "left")
    named = written(own.select("text_id", "pos", "tokens", F.coalesce("component", "name").alias("template")), "line-templates")
    forget(lines, labels)  # nothing reads them from here on
    gone = named.select("text_id", "pos", "template").join(few(recurring(named, min_documents, related, centers)), "template", "left_semi")
    # a repeated row has each of its lines as often, so places count once
    told = written(gone.groupBy(F.col("text_id").alias("__text_id")).agg(F.collect_set("pos").alias("__gone")), "line-gone")
    forget(named)
    kept = docs.join(few(told), name_of(F.col("text")) == F.col("__text_id"), "left")
    fields = [*docs.columns, "__gone"]
    # the lines are parted once a row: a lambda would part the text again for each of them
    split = computed(kept.select(*[F.col(f"`{c}`") for c in fields]), __lines=F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNotNull(), F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.regexp_count("text", F.lit(f"[^{BLANKS}\n][^\n]*")), F.lit(0)).cast("long")
    n_dropped = F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long")
    return split.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))).select("doc_id", "n_lines", "n_dropped", "text")


def _components_sql(edges: str, out: str) -> str:
    """Least reachable node of every node of edges (x, y)."""
    return f"""{edges}_both AS (SELECT x, y FROM {edges} UNION SELECT y, x FROM {edges}),
{edges}_reach(node, seen) AS (SELECT x, x FROM {edges}_both UNION SELECT b.y, r.seen FROM {edges}_reach r JOIN {edges}_both b ON b.x = r.node WHERE b.y > r.seen),
{out} AS (SELECT node, min(seen) AS component FROM {edges}_reach GROUP BY node)"""


#: The same result by all pairs of lines of a leaf and all pairs of texts that share a template.
OP10_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT text, ('0x' || md5(text)[1:15])::BIGINT AS text_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
), normal AS (
  SELECT text_id, pos, regexp_replace(regexp_replace(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '[ 	
]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM split
), lines AS (
  SELECT text_id, pos, ('0x' || md5(line)[1:15])::BIGINT AS name, len(string_split(line, ' ')) || ' ' || array_to_string(string_split(line, ' ')[1:{LEADING}], ' ') AS leaf, least(len(string_split(line, ' ')), {MOST_TOKENS}) AS tokens, line FROM normal WHERE line <> ''
), variants AS (
  SELECT DISTINCT leaf, name, string_split(line, ' ') AS words, len(string_split(line, ' ')) AS size, floor(tokens * (1 - {SIMILARITY}) + 1e-9)::INT AS d FROM lines WHERE floor(tokens * (1 - {SIMILARITY}) + 1e-9) > 0
), own_lines AS (SELECT * FROM variants WHERE leaf IN (SELECT leaf FROM variants GROUP BY leaf HAVING count(*) > 1)
), line_links AS (
  SELECT a.name AS x, b.name AS y FROM own_lines a JOIN own_lines b ON a.leaf = b.leaf AND a.name < b.name WHERE len(list_filter(list_zip(a.words, b.words), lambda z: z[1] <> z[2])) <= a.d
), {_components_sql("line_links", "line_labels")},
named AS (SELECT text_id, pos, tokens, coalesce(component, name) AS template FROM lines LEFT JOIN line_labels ON node = name),
own AS (SELECT DISTINCT text_id, template, tokens FROM named),
shared AS (SELECT template, count(*) AS n, max(tokens) AS size FROM own GROUP BY template HAVING count(*) > 1),
open_texts AS (SELECT text_id, sum(tokens) AS tokens FROM own LEFT JOIN shared USING (template) GROUP BY text_id HAVING sum(CASE WHEN n IS NOT NULL THEN tokens ELSE 0 END) >= {RELATED} * sum(tokens)),
held AS (SELECT o.text_id, o.template, o.tokens AS size FROM own o JOIN open_texts USING (text_id) JOIN shared USING (template)),
text_pairs AS (SELECT DISTINCT a.text_id AS x, b.text_id AS y FROM held a JOIN held b ON b.template = a.template AND a.text_id < b.text_id),
overlap AS (SELECT x, y, sum(a.size) AS both_ FROM text_pairs JOIN held a ON a.text_id = x JOIN held b ON b.text_id = y AND b.template = a.template GROUP BY x, y),
text_links AS (SELECT x, y FROM overlap JOIN open_texts m ON m.text_id = x JOIN open_texts n ON n.text_id = y WHERE both_ >= {RELATED} * (m.tokens + n.tokens - both_)),
{_components_sql("text_links", "text_labels")},
dropped AS (SELECT template FROM own LEFT JOIN text_labels ON node = text_id GROUP BY template HAVING count(DISTINCT coalesce(component, text_id)) >= {MIN_DOCUMENTS}),
marked AS (SELECT s.text, s.pos, s.raw, n.template IS NOT NULL AS counts, d.template IS NOT NULL AS gone FROM split s LEFT JOIN named n ON n.text_id = s.text_id AND n.pos = s.pos LEFT JOIN dropped d ON d.template = n.template),
done AS (SELECT text, count(*) FILTER (counts) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS new_text FROM marked GROUP BY text)
SELECT o.doc_id, coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_dropped, 0) AS n_dropped, CASE WHEN o.text IS NULL THEN NULL ELSE d.new_text END AS text
FROM documents o LEFT JOIN done d ON d.text = o.text
"""
