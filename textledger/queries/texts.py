"""Queries of the text, token and linguistic functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as G
from ..functions import numbers as D
from ..functions import text as X
from ..functions import tokens as T
from ..functions.rowwise import spread
from ..plans import names as N
from .registry import query, table

#: Each turn with the one after it, as a source and its target.
PAIRS = "(SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1)"


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(after, ["conv_id", "turn"])


@query("SELECT lang, count(*) AS words, count(DISTINCT w) AS distinct_words, max(length(w)) AS longest FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+(?:[''’-]\\p{L}+)*')) AS w FROM documents) GROUP BY lang")
def joined_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(G.joined_words(F.col("text"))).alias("w"))
    return words.groupBy("lang").agg(F.count("*").alias("words"), F.count_distinct("w").alias("distinct_words"), F.max(F.length("w")).cast("long").alias("longest"))


@query("SELECT p_partkey, trim(replace(replace(replace('  ' || replace(p_name || ' ' || p_type || ' reddish', ' ', '  ') || '  ', ' red  widget ', ' crimson  gadget '), ' gadget ', ' GADGET '), ' red ', ' ruby ').replace('  ', ' ')) AS replaced FROM part")
def boundary_cascade(spark, sf_dir):
    """Phrases at word borders, longest first, each reading what the one before wrote."""
    rules = [("red", "ruby"), ("gadget", "GADGET"), ("red widget", "crimson gadget")]
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("reddish"))
    return table(spark, sf_dir, "part").select("p_partkey", G.replace_words(text, rules).alias("replaced"))


@query("SELECT p_partkey, replace(replace(replace(p_name || ' ' || p_type, 'red', chr(1)), 'blue', 'red'), chr(1), 'blue') AS replaced FROM part")
def single_pass(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.replace_once(F.concat_ws(" ", "p_name", "p_type"), {"red": "blue", "blue": "red"}).alias("replaced"))


_KNOWN = "map {'small': 'little', 'red': 'ruby', 'widget': 'gadget', 'economy': 'cheap'}"


@query(f"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE upper(p_name[1]) || p_name[2:] END || ' ' || p_type, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w:
 CASE WHEN {_KNOWN}[lower(w)] IS NULL THEN w WHEN length(w) > 1 AND upper(w) = w AND lower(w) <> w THEN upper({_KNOWN}[lower(w)])
 WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN upper({_KNOWN}[lower(w)][1]) || {_KNOWN}[lower(w)][2:] ELSE {_KNOWN}[lower(w)] END), '') AS replaced FROM part""")
def dialect_words(spark, sf_dir):
    """Words of one dialect by another's, in the case they have."""
    name = F.col("p_name")
    first = F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1000))
    cased = F.when(F.col("p_size") % 3 == 0, name).when(F.col("p_size") % 3 == 1, F.upper(name)).otherwise(first)
    words = {"small": "little", "red": "ruby", "widget": "gadget", "economy": "cheap"}
    return table(spark, sf_dir, "part").select("p_partkey", G.dialect(F.concat(cased, F.lit(" "), "p_type"), words).alias("replaced"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Sırada ' || o_custkey || ' / ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_custkey || ' adet ' || o_orderstatus END AS rewritten FROM orders""")
def templates(spark, sf_dir):
    """Typed templates: the first pattern that matches a whole text rewrites it."""
    k, c, s = (F.col(x).cast("string") for x in ("o_orderkey", "o_custkey", "o_orderstatus"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Rank "), c, F.lit(" of "), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Get "), c, F.lit(" times "), s)).otherwise("Rank none of all")
    rules = [("Rank ([0-9]+) of ([0-9]+)", "Sırada $1 / $2"), (r"Get ([0-9]+) times (\p{L}+)", "$1 adet $2")]
    return table(spark, sf_dir, "orders").select("o_orderkey", G.first_template(text, rules).alias("rewritten"))


@query("SELECT p_partkey, trim(regexp_replace(replace(replace('  ' || replace(p_name || ' of ' || p_type, ' ', '  ') || '  ', ' widget ', '   '), ' SMALL ', '   '), ' +', ' ', 'g')) AS bare FROM part")
def stripped_names(spark, sf_dir):
    text = G.without_names(F.concat_ws(" ", "p_name", F.lit("of"), "p_type"), ["widget", "SMALL"])
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(text, " +", " ")).alias("bare"))


# The sentence's parts are cut apart first: clocks, then thousands, then what is left.
_NUMBERS = r"""list_sort(list_concat(
 list_transform(regexp_extract_all(t, '[0-9]{1,2}:[0-5][0-9]'), lambda x: 'time:' || lpad(x, 5, '0')),
 list_transform(regexp_extract_all(t, 'saat ([0-9]{2}\.[0-5][0-9])', 1), lambda x: 'time:' || replace(x, '.', ':')),
 list_transform(regexp_extract_all(t, '([0-9]+(?:,[0-9]+)?) bin', 1), lambda x: CAST(CAST(round(CAST(replace(x, ',', '.') AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)),
 list_transform(regexp_extract_all(regexp_replace(regexp_replace(t, '[0-9]{1,2}:[0-5][0-9]|saat [0-9.]+|[0-9]+(?:,[0-9]+)? bin', ' ', 'g'), ' x([0-9])', ' \1', 'g'), '[+-]?% ?[0-9]+(?:[.,][0-9]+)*|[+-]?[0-9]+(?:[.,][0-9]+)*(?: ?%)?'), lambda r:
  CASE WHEN contains(r, '-') THEN '-' ELSE '' END || regexp_replace(CASE WHEN NOT contains(r, '%') AND regexp_full_match(regexp_replace(r, '[ +%-]', '', 'g'), '[0-9]{1,3}(?:[.,][0-9]{3})+') THEN regexp_replace(r, '[ +%.,-]', '', 'g') ELSE replace(regexp_replace(r, '[ +%-]', '', 'g'), ',', '.') END, '^0+([0-9])', '\1') || CASE WHEN contains(r, '%') THEN '%' ELSE '' END)))"""
_SAID = "concat_ws(' ', 'at', CAST(o_orderkey % 24 AS VARCHAR) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0'), 'pay', CAST(o_custkey % 90 AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), 'or', '%' || CAST(o_custkey % 100 AS VARCHAR), 'and', CAST(o_orderkey % 100 AS VARCHAR) || ' %', 'of', CAST(o_custkey % 9 AS VARCHAR) || ' bin coins', 'x' || CAST(o_orderkey % 7 AS VARCHAR), '-' || CAST(o_custkey % 50 AS VARCHAR) || '.5', '+007', 'saat 0' || CAST(o_custkey % 10 AS VARCHAR) || '.' || CAST(10 + o_orderkey % 50 AS VARCHAR), 'ile', CAST(o_custkey % 7 AS VARCHAR) || ',' || CAST(1 + o_orderkey % 9 AS VARCHAR) || ' bin', 'ya da', '%' || CAST(o_custkey % 80 AS VARCHAR) || ',5')"


def _said():
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    return F.concat_ws(" ", F.lit("at"), F.concat(s(k % 24), F.lit(":"), F.lpad(s(c % 60), 2, "0")), F.lit("pay"), F.concat(s(c % 90), F.lit(","), F.lpad(s(k % 1000), 3, "0")), F.lit("or"), F.concat(F.lit("%"), s(c % 100)), F.lit("and"), F.concat(s(k % 100), F.lit(" %")), F.lit("of"), F.concat(s(c % 9), F.lit(" bin coins")), F.concat(F.lit("x"), s(k % 7)), F.concat(F.lit("-"), s(c % 50), F.lit(".5")), F.lit("+007"), F.concat(F.lit("saat 0"), s(c % 10), F.lit("."), s(10 + k % 50)), F.lit("ile"), F.concat(s(c % 7), F.lit(","), s(1 + k % 9), F.lit(" bin")), F.lit("ya da"), F.concat(F.lit("%"), s(c % 80), F.lit(",5")))


@query(f"SELECT o_orderkey, array_to_string({_NUMBERS}, ' ') AS numbers FROM (SELECT o_orderkey, {_SAID} AS t FROM orders)")
def numeric_signatures(spark, sf_dir):
    """Times, thousands, percentages, signs and decimals of a sentence in one spelling."""
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.array_join(D.numeric_signature(_said()), " ").alias("numbers"))


# Words of the numbers 21 to 99 and of thousands of them, said by the query; 0 to 3: digits or words on either side, another number, a lost sign.
_EN_UNITS, _EN_TENS = "one two three four five six seven eight nine".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split()
_TR_UNITS, _TR_TENS = "bir iki üç dört beş altı yedi sekiz dokuz".split(), "yirmi otuz kırk elli altmış yetmiş seksen doksan".split()


@query("SELECT o_orderkey, o_custkey % 5 <> 3 AS explained FROM orders")
def number_words(spark, sf_dir):
    """Digits on one side and the same number in words on the other agree (a loss may be said by a verb); another number does not."""
    kind, k = F.col("o_custkey") % 5, F.col("o_orderkey")
    unit, ten = (k % 9).cast("int"), (k % 8).cast("int")
    word = lambda words, at: F.element_at(F.array(*map(F.lit, words)), at + 1)
    n = 10 * (ten + 2) + unit + 1
    large = k % 2 == 1
    digits = F.when(large, n * 1000).otherwise(n).cast("string")
    en = F.concat(word(_EN_TENS, ten), F.lit("-"), word(_EN_UNITS, unit), F.when(large, " thousand").otherwise(""))
    tr = F.concat(word(_TR_TENS, ten), F.lit(" "), word(_TR_UNITS, unit), F.when(large, " bin").otherwise(""))
    source = F.concat(F.lit("take "), F.when(kind.isin(0, 2), en).when(kind == 4, F.concat(F.lit("-"), digits)).otherwise(digits), F.lit(" coins"))
    target = F.concat(F.when(kind == 0, digits).when(kind == 4, F.concat(digits, F.lit(" azalır"))).when(kind == 3, (n + 1).cast("string")).otherwise(tr), F.lit(" para al"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", D.numbers_explained(source, target).alias("explained"))


@query("SELECT o_orderkey, o_custkey % 5 NOT IN (0, 4) AS same FROM orders")
def percent_lists(spark, sf_dir):
    """``%50`` and ``50 %`` agree, and so do decimals with comma and point; a lost digit or sign does not."""
    k, kind = (F.col("o_orderkey") % 90).cast("string"), F.col("o_custkey") % 5
    target = F.when(kind == 0, F.concat(F.lit("yarım "), k, F.lit(" fazla"))).when(kind == 4, F.concat(F.lit("%3,5 ve %7"), k)).otherwise(F.concat(F.lit("% "), k, F.lit(",5 fazla ve 7%")))
    source = F.when(kind == 4, F.concat(F.lit("13,5% and 7"), k, F.lit("%"))).otherwise(F.concat(F.lit("%7 and "), k, F.lit(".5 % more")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (D.percentages(source) == D.percentages(target)).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND length(regexp_extract(p_name, '^[a-z]+')) >= 4 THEN regexp_extract(p_name, '^[a-z]+') || 'taşı' END AS glued, CASE WHEN p_size % 3 = 1 AND length(regexp_extract(p_name, '[a-z]+$')) >= 4 AND regexp_extract(p_name, '[a-z]+$') <> 'ring' THEN regexp_extract(p_name, '[a-z]+$') END AS copied FROM part")
def glued_and_copied(spark, sf_dir):
    """Source words glued to others in the target, and source words left as they are."""
    first, last = F.regexp_extract("p_name", "^[a-z]+", 0), F.regexp_extract("p_name", "[a-z]+$", 0)
    kind = F.col("p_size") % 3
    target = F.when(kind == 0, F.concat(first, F.lit("taşı"))).when(kind == 1, F.concat(F.lit("bir "), last)).otherwise(F.concat(first, F.lit("lar")))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", G.glued_word(F.col("p_name"), target, ["lar", "ler"]).alias("glued"), G.copied_word(F.col("p_name"), target, ["ring"]).alias("copied"))


@query("""SELECT p_partkey, h AS prefix, t AS suffix, substr(a, h + 1, length(a) - h - t) AS was, substr(b, h + 1, length(b) - h - t) AS now FROM (
SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) - h + 1), lambda i: right(a, i) = right(b, i))) AS t FROM (
SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS h FROM (SELECT p_partkey, p_name || ' ' || p_type AS a, replace(p_name, 'i', 'ii') || ' new ' || p_type AS b FROM part)))""")
def changed_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat_ws(" new ", F.replace("p_name", F.lit("i"), F.lit("ii")), "p_type").alias("b"))
    return rows.select("p_partkey", G.changed_span(F.col("a"), F.col("b")).alias("s")).select("p_partkey", F.col("s.prefix").cast("long").alias("prefix"), F.col("s.suffix").cast("long").alias("suffix"), "s.was", "s.now")


_LAST = f"regexp_extract(n, '([{G.VOWELS}])[^{G.VOWELS}]*$', 1)"
_FORM = f"CASE WHEN regexp_matches(n, '[{G.VOWELS}]$') THEN {{1}} ELSE {{0}} END"
_TWO = f"CASE WHEN {_LAST} = '' THEN 'e' ELSE translate({_LAST}, '{G.VOWELS}', '{G.TWO_FORMS}') END"
_FOUR = f"CASE WHEN {_LAST} = '' THEN 'i' ELSE translate({_LAST}, '{G.VOWELS}', '{G.FOUR_FORMS}') END"


def _case_sql(case: str) -> str:
    closed, open_ = (f"'{x}'" for x in G.CASES[case])
    form = _FORM.format(closed, open_)
    form = f"CASE WHEN starts_with({form}, 'd') AND regexp_matches(n, '{G._HARD}') THEN regexp_replace({form}, '^d', 't') ELSE {form} END"
    return f"n || '''' || replace(replace({form}, 'A', {_TWO}), 'I', {_FOUR})"


@query(f"SELECT n, {', '.join(f'{_case_sql(c)} AS {c}' for c in G.CASES)}, n AS bare FROM (SELECT DISTINCT regexp_extract(p_name, '[a-z]+$') AS n FROM part UNION SELECT DISTINCT lower(p_type) || 'r' FROM part UNION SELECT DISTINCT regexp_extract(p_name, '^[a-z]+') FROM part)")
def case_suffixes(spark, sf_dir):
    """Names with each case suffix by vowel harmony, and back."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.regexp_extract("p_name", "[a-z]+$", 0).alias("n")).union(part.select(F.concat(F.lower("p_type"), F.lit("r")))).union(part.select(F.regexp_extract("p_name", "^[a-z]+", 0))).distinct()
    return names.select("n", *[G.with_case(F.col("n"), c).alias(c) for c in G.CASES], G.without_case(G.with_case(F.col("n"), "ablative")).alias("bare"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '[“”„]', '""', 'g'), '[‘’]', '''', 'g'), '…', '...'), ' +([,.!?;:])', '\1', 'g'), '  +', ' ', 'g'), '^ +| +$', '', 'g')) AS tidy_sha256 FROM documents".replace('""', '"'))
def typography(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(G.typography(F.col("text")), 256).alias("tidy_sha256"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'SELL' WHEN 1 THEN 'BUY' END AS kind, p_name AS item, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || 'k' END AS price FROM part")
def trade_lines(spark, sf_dir):
    prefix = F.when(F.col("p_size") % 3 == 0, "WTS ").when(F.col("p_size") % 3 == 1, "WTB  ").otherwise("")
    line = F.concat(prefix, "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("k"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", G.trade(line).alias("t")).select("p_partkey", "t.kind", "t.item", "t.price")


@query("SELECT o_orderkey, chr(CAST(65 + (o_orderkey // 17576) % 26 AS INT)) || chr(CAST(65 + (o_orderkey // 676) % 26 AS INT)) || chr(CAST(65 + (o_orderkey // 26) % 26 AS INT)) || chr(CAST(65 + o_orderkey % 26 AS INT)) AS mark FROM orders")
def sentinels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.base26(F.col("o_orderkey"), 4).alias("mark"))


@query("SELECT conv_id, turn, sha256(trim(text)) AS clean_sha256, left(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 90) AS short FROM conversations")
def generated_texts(spark, sf_dir):
    """Model output without its reasoning and label, and texts as one-line errors."""
    said = F.concat(F.lit("<think>a\nb</think>\n Output: "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(G.generated(said), 256).alias("clean_sha256"), G.short_error(F.col("text")).alias("short"))


@query("SELECT conv_id, turn, sha256(replace(CASE WHEN turn % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END, chr(10), chr(92) || 'n')) AS as_was, sha256(CASE WHEN turn % 2 = 0 AND contains(text, chr(10) || chr(10)) THEN replace(text, chr(10), chr(92) || 'n' || chr(92) || 'n') ELSE replace(text, chr(10), chr(92) || 'n') END) AS repaired FROM conversations")
def newline_repairs(spark, sf_dir):
    """Doubled line feeds made single where the source has single ones only."""
    rows = table(spark, sf_dir, "conversations")
    one = F.replace("text", F.lit("\n"), F.lit("\\n"))
    was = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\\n\\n"))).otherwise(one)
    return rows.select("conv_id", "turn", F.sha2(was, 256).alias("as_was"), F.sha2(G.single_newlines(one, was), 256).alias("repaired"))


@query("SELECT doc_id, sha256(text) AS repaired_sha256 FROM documents")
def encoding_repairs(spark, sf_dir):
    """Texts that were read in the wrong encoding, where their characters allow it, and put right."""
    fits = ~F.col("text").rlike(r"[^\u0000-ÿ]") & ~F.col("text").rlike(r"[Â-ô][\u0080-¿]") & F.col("text").rlike(r"[\u0080-ÿ]")
    broken = F.when(fits, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(G.repaired(broken), 256).alias("repaired_sha256"))


_BLANK = "array_to_string(list_transform(regexp_extract_all(translate(html, '{{}}', '  '), '(?s)<[^>]*>|[^<]+|<'), lambda p: CASE WHEN regexp_full_match(p, '(?s)<[^>]*>') THEN repeat(' ', length(p)) ELSE p END), '')"


@query(f"SELECT page_id, length(html) + 29 AS n, sha256({_BLANK.format()} || repeat(' ', 21) || 'word   x') AS blank_sha256 FROM pages")
def blanked_tokens(spark, sf_dir):
    """Pages, with tokens of every kind behind them, and each token as blanks of its length."""
    rows = tokened(spark, sf_dir).select("page_id", D.visible_text("html").alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("blank_sha256"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-') || '-' || left(sha256(p_name || ' / ' || p_brand), 12) AS slug FROM part")
def hashed_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_brand"), 12).alias("slug"))


@query("SELECT conv_id, turn, turn % 2 = 0 AS gibberish FROM conversations")
def gibberish_texts(spark, sf_dir):
    """Long marks with few letters are no text; turns themselves are."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("#1a!2b-3c = 4d;"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("some "), F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.gibberish(text).alias("gibberish"))


# Whole pages with every kind of token behind them.
_TOKENED = "(SELECT page_id, html || ' [#1] %name% ' || chr(92) || 'n{[~1]?word:} x' AS html FROM pages)"


def tokened(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.concat("html", F.lit(" [#1] %name% \\n{[~1]?word:} x")).alias("html"))


@query(f"SELECT page_id, len(regexp_extract_all(html, '<[^>]*>')) + 5 AS tokens, length(html) AS rejoined FROM {_TOKENED}")
def token_segments(spark, sf_dir):
    """Pages cut into tokens, blanks and prose, and joined again: tags, and the last five tokens of other kinds."""
    cut = tokened(spark, sf_dir).select("page_id", "html", T.token_segments("html").alias("s"))
    tokens = F.size(F.filter("s", lambda x: ~x["prose"] & (x["text"].startswith("<") | x["text"].isin("[#1]", "%name%", "\\n", "{[~1]?", ":"))))
    return cut.select("page_id", tokens.cast("long").alias("tokens"), F.length(F.array_join(F.transform("s", lambda x: x["text"]), "")).cast("long").alias("rejoined"))


@query(f"SELECT page_id, len(regexp_extract_all(regexp_replace(html, '[{{]\\[~1\\][?]word:[}}]', ''), '<[^>]*>|[{{}}]')) + 6 AS tokens, sha256(html) AS restored_sha256 FROM {_TOKENED}")
def masked_tokens(spark, sf_dir):
    """Pages with tokens masked by private characters, and restored: tags, braces, and six tokens of other kinds."""
    pages = tokened(spark, sf_dir).select("page_id", T.masked_text("html").alias("m"))
    return pages.select("page_id", F.size("m.tokens").cast("long").alias("tokens"), F.sha2(T.unmasked_text("m.masked", "m.tokens"), 256).alias("restored_sha256"))


_KNOWN = "CASE WHEN p_name LIKE 'red %' THEN 'kırmızı' ELSE p_name END"


@query(f"SELECT p_partkey, '<b>' || {_KNOWN} || '</b>' || chr(92) || 'n[#1] ' || p_type || '{{[~1]?s:}} {{[>1]?' || {_KNOWN} || ' {{[=2]?' || p_brand || ':iki [#2]}}:' || {_KNOWN} || '}}' AS translated, CASE WHEN p_name LIKE 'red %' THEN 2 ELSE 5 END AS missing FROM part")
def translated_segments(spark, sf_dir):
    """Prose between tokens and in the branches of nested conditionals looked up in a dictionary; tokens and a word's endings are never looked up."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit("<b>"), "p_name", F.lit("</b>\\n[#1] "), "p_type", F.lit("{[~1]?s:} {[>1]?"), "p_name", F.lit(" {[=2]?"), "p_brand", F.lit(":two [#2]}:"), "p_name", F.lit("}"))
    known = part.where(F.col("p_name").like("red %")).select(F.col("p_name").alias("source"), F.lit("kırmızı").alias("value"))
    known = known.union(spark.createDataFrame([("two", "iki"), ("s", "wrong")], known.schema))
    out = T.translate_segments(part.select("p_partkey", text.alias("text")), "p_partkey", "text", known)
    return out.select("p_partkey", "translated", F.col("missing").cast("int").alias("missing"))


@query("SELECT p_partkey, p_type || '{[~1]?s:}' AS grafted, '<B>' || p_type || '</b> [#One]' AS aligned FROM part")
def token_repairs(spark, sf_dir):
    """Plural markers of the source's end set behind the target, and tokens in the source's spelling."""
    source = F.concat("p_name", F.lit("{[~1]?s:}"))
    spelt = F.concat(F.lit("<B>"), "p_name", F.lit("</b> [#One]"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", T.grafted(source, "p_type").alias("grafted"), T.aligned(spelt, F.concat(F.lit("<b>"), "p_type", F.lit("</B> [#one]"))).alias("aligned"))


@query("SELECT p_type, min_by('[#' || CASE WHEN p_partkey % 2 = 0 THEN 'ONE' ELSE 'one' END || '] ' || p_type, p_partkey) AS value FROM part WHERE p_type <> 'SMALL' GROUP BY p_type")
def one_token_spelling(spark, sf_dir):
    """Values of a key that differ in their tokens' case alone become the first one; SMALL also differs in prose, and is left out."""
    mark = F.when(F.col("p_partkey") % 2 == 0, "[#ONE] ").otherwise("[#one] ")
    prose = F.when((F.col("p_type") == "SMALL") & (F.col("p_partkey") % 3 == 0), "small").otherwise(F.col("p_type"))
    return T.one_spelling(table(spark, sf_dir, "part").select("p_type", "p_partkey", F.concat(mark, prose).alias("value")), "p_type", "p_partkey", "value")


@query("SELECT conv_id * 1000 + turn AS k, sum(len(regexp_extract_all(' ' || text, '(?i)[^\\p{L}\\p{N}](?:die|und)(?:$|[^\\p{L}\\p{N}])'))) AS n FROM (SELECT conv_id, turn, replace(replace(text, ' ', '  '), chr(10), chr(10) || chr(10)) AS text FROM conversations) GROUP BY ALL HAVING n > 0")
def border_names(spark, sf_dir):
    """How often a dictionary's words stand at word borders in each turn, ignoring case."""
    names = spark.createDataFrame([("die",), ("und",)], "name string")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return N.scan(rows, "k", "text", names, "name").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 1 + CASE WHEN regexp_matches(p_name, '(^| )red ring($| )') THEN 1 WHEN regexp_matches(p_name, '(^| )red($| )') OR regexp_matches(p_name, '(^| )ring($| )') THEN 1 ELSE 0 END AS tokens, p_name || '[#1]' AS restored FROM part")
def protected_names(spark, sf_dir):
    """Names and tokens hidden from a provider, and back again."""
    names = spark.createDataFrame([("red",), ("ring",), ("red ring",)], "name string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("[#1]")).alias("text"))
    hidden = N.protect(rows, "p_partkey", "text", names, "name")
    return hidden.select("p_partkey", F.size("tokens").alias("tokens"), N.restored(F.col("masked"), F.col("tokens")).alias("restored"))
