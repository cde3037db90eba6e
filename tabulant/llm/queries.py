"""Registered queries of the training-data operators: thin digests over whole tables.

Each query reads the whole table with production parameters, runs its
operator from this folder and derives the columns that are compared.
``ORACLE_SQL`` has DuckDB SQL where SQL can express the result; the others are
tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table_path
from . import alignment, ann, conversations, decontaminate, line_dedup, mixing, pieces, pii, secrets, sharding, simhash, toxicity
from . import fingerprint as fp
from .common import stage, successor_blocks


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf, name))


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash near-duplicates: 4-word shingles, links at 4 or fewer differing bits, the smallest id reachable."""
    return simhash.near_duplicates(_table(spark, sf, "documents"), shingle=4, max_bits=4)


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate secret of every document, with the score of a forest that learned from planted findings.

    The tables hold no reviewed findings: secrets and look-alikes are planted in
    copies of passages of four fifths of the documents (``secrets.planted``).
    """
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source")
    return secrets.scan(docs, findings=secrets.planted(docs.filter(~held_out())))


def op3_sentencepiece(spark: SparkSession, sf: str, model: str | None = None) -> DataFrame:
    """Every document's piece ids, their number, and whether decoding them gives the text again."""
    vocabulary = pieces.Vocabulary.load(model or pieces.default_model())
    encoded = pieces.encode(_table(spark, sf, "documents"), vocabulary, check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest by cosine of every vector whose id is divisible by 50, among all others."""
    return ann.nearest(_table(spark, sf, "embeddings"), F.col("id") % 50 == 0, k=5)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of a document are kept from learning: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.filter(~held_out()))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every whole text, learned from labels of documents that are not held out."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset fingerprints of every document and of its edited text, and their likeness to it and to the next.

    The texts are shuffled once, into blocks of neighbouring ids; fingerprints
    and the look at the next document's stay within those blocks.
    """
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = successor_blocks(docs, "doc_id", "text", "next_text")
    edited = F.expr("substring(text, 1, char_length(text) - char_length(text) div 4)"
                    " || substring(next_text, 1, char_length(text) div 4)")
    docs = docs.withColumn("edited", F.when(F.col("__tail") == 0, edited))
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                             F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))),
                     lambda k: k["body"].isNotNull())
    row = ["__block", "__tail", "__row", "doc_id", "n_chars", "edited_sha256"]
    both = docs.select("__block", "__tail", "__row", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(kinds))
    prints = fp.fingerprint(both, [*row, "kind"], "body").groupBy(*row).agg(
        F.max(F.when(F.col("kind") == 0, F.col("lanes"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("lanes"))).alias("edited"))
    follow = F.lead("own").over(Window.partitionBy("__block").orderBy("__row"))
    return prints.withColumn("next", follow).filter("__tail = 0").select(
        "doc_id", "n_chars", "edited_sha256", fp.to_hex(F.col("own")).alias("fingerprint"),
        fp.to_hex(F.col("edited")).alias("edited_fingerprint"),
        fp.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        F.coalesce(fp.likeness(F.col("own"), F.col("next")), F.lit(0.0)).alias("near_next"))


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document: base spans by kind, and all spans with those the tagger adds."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    tagger = pii.train(pii.labelled_windows(docs))
    found = pii.find(docs, tagger)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_text(F.concat("base", "added")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: its lines, how many repeat an earlier line, and which (counted from 0).

    Lines of at least 24 characters repeat others within 2 edits, shorter ones if they are equal; blank lines are out.
    """
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    repeats = line_dedup.duplicate_lines(docs, max_edits=2).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("line")).alias("repeated_lines"))  # no longer than the document
    lines = docs.select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
    empty = F.array().cast("array<int>")
    return lines.join(repeats, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("repeated_lines"), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("repeated_lines", empty).alias("repeated_lines"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes by sampled splitters."""
    placed = sharding.assign_shards(_table(spark, sf, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# Fixed values of the mixing query: the share of tokens to take and the weights of the tree's nodes (1 elsewhere).
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 42
MIX_WEIGHTS = {("books",): 2, ("forums",): 1, ("web",): 3,
               ("books", "en"): 4, ("books", "de"): 2, ("books", "fr"): 2, ("books", "es"): 1,
               ("forums", "en"): 3, ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2}


def mix_levels(source: str = "source", lang: str = "lang") -> dict:
    """Domain, language and source of a document; the domain of a source is the first digit of its MD5."""
    digit = F.substring(F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary")), 1, 1)
    domain = F.when(digit < "5", "books").when(digit < "a", "forums").otherwise("web")
    return {"domain": domain, "lang": F.col(lang), "source": F.col(source)}


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents taken from each (domain, language, source) leaf so that 80 % of all tokens follow the weights."""
    levels = mix_levels()
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source",
                                                 mixing.count_tokens(F.col("text")).alias("tokens"))
    docs = stage(docs, "op10-tokens")
    mixed = mixing.mix(docs, levels, mixing.node_weights(spark, MIX_WEIGHTS), budget_percent=MIX_PERCENT,
                       max_epochs=MIX_EPOCHS, seed=MIX_SEED, tokens_col="tokens")
    return mixed.select("doc_id", *[c.alias(n) for n, c in levels.items()], "tokens", F.col("epoch").cast("long"))


def mix_oracle(table: str, columns: str, tokens: str, percent: int, epochs: int, seed: int) -> str:
    """DuckDB SQL of the mixing query over ``table``: one window per leaf and epoch, no key ranges."""
    weights = ", ".join(f"('{'/'.join(p)}', {w})" for p, w in MIX_WEIGHTS.items())

    def fill(k: int, source: str, parent: str, path: str) -> str:
        """Share out the parents' ``b``: a child is full if its cap is below its share once all tighter ones are."""
        return f"""
, n{k} as (select t.*, coalesce((select w from weights x where x.path = t.path), 1)::hugeint w from ({source}) t)
, f{k} as (select a.*, a.cap * (select sum(c.w) from n{k} c where {parent} and (c.cap / c.w, c.path) >= (a.cap / a.w, a.path))
      <= a.w * (a.b - coalesce((select sum(c.cap) from n{k} c where {parent}
                                and (c.cap / c.w, c.path) < (a.cap / a.w, a.path)), 0)) as is_full from n{k} a)
, r{k} as (select a.*, a.b - coalesce((select sum(c.cap) from f{k} c where {parent} and c.is_full), 0) rest,
      (select sum(c.w) from f{k} c where {parent} and not c.is_full) open_w,
      coalesce((select sum(c.w) from f{k} c where {parent} and not c.is_full and c.path < a.path), 0) w0 from f{k} a)
, g{k} as (select * exclude (b), case when is_full then cap else (rest * (w0 + w)) // open_w - (rest * w0) // open_w end got
      from r{k})"""

    first = f"""select domain, domain as path, sum(cap)::hugeint cap,
        least((select sum(t) * {percent} // 100 from d), (select sum(cap) from leaves))::hugeint b from leaves group by 1, 2"""
    second = """select l.domain, l.lang, l.domain || '/' || l.lang as path, sum(l.cap)::hugeint cap, any_value(p.got) b
        from leaves l join g1 p using (domain) group by 1, 2, 3"""
    third = """select l.domain, l.lang, l.source, l.domain || '/' || l.lang || '/' || l.source as path, l.cap, p.got b
        from leaves l join g2 p using (domain, lang)"""
    return f"""with weights(path, w) as (values {weights})
, d as (select {columns}, {tokens} as t, case when substr(md5(coalesce(source, '')), 1, 1) < '5' then 'books'
        when substr(md5(coalesce(source, '')), 1, 1) < 'a' then 'forums' else 'web' end as domain from {table})
, leaves as (select domain, coalesce(lang, '(null)') lang, coalesce(source, '(null)') source, sum(t)::hugeint total,
        sum(t)::hugeint * {epochs} cap from d group by 1, 2, 3 having sum(t) > 0)
{fill(1, first, "true", "domain")}{fill(2, second, "c.domain = a.domain", "lang")}{fill(
        3, third, "c.domain = a.domain and c.lang = a.lang", "source")}
, plan as (select g.domain, g.lang, g.source, g.got // l.total as whole, g.got % l.total as rest
        from g3 g join leaves l using (domain, lang, source))
, keyed as (select d.*, p.whole, p.rest, sum(d.t) over (partition by d.domain, d.lang, d.source
        order by md5('{seed}:' || p.whole || ':' || coalesce(d.doc_id::varchar, '')), d.t rows unbounded preceding) as upto
        from d join plan p on d.domain = p.domain and coalesce(d.lang, '(null)') = p.lang
        and coalesce(d.source, '(null)') = p.source)
, mixed as (select k.* exclude (whole, rest, upto), e.epoch from keyed k,
        (select unnest(range({epochs})) as epoch) e where e.epoch < k.whole
        union all select * exclude (whole, rest, upto), whole::bigint from keyed where rest > 0 and upto <= rest)
"""


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: byte-level BPE tokens against SentencePiece tokens, their common cuts, links and corpus-wide counts."""
    a, b = alignment.ByteLevel.load(), alignment.Pieces.load()
    return alignment.align(_table(spark, sf, "documents"), a, b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: words in occurrences of 10 consecutive words of a benchmark item (or a whole shorter one), and the items."""
    found = decontaminate.scan(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), window=10)
    n_hit = decontaminate.count_hits(F.col("runs"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation, damaged by a rule on its keys: faults counted, and the cheapest repair of its turns."""
    turns = _table(spark, sf, "conversations")
    return conversations.repair(conversations.damage(turns), turns).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# Item windows and document words as joins: every text's runs of as many words as a window has.
DECONTAMINATION_SQL = r"""
with items as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark)
, windows as (select item_id, least(len(w), 10) as k, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i, w from items
        where len(w) > 0)
, pattern as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as p from windows)
, docs as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents)
, runs as (select r, k, unnest(generate_series(1, len(w) - k + 1)) as i, w from docs, (select distinct k from pattern) where len(w) >= k)
, found as (select r, i, k, item_id from (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as p from runs) join pattern using (k, p))
, hits as (select r, count(distinct j) as n from (select r, unnest(generate_series(i, i + k - 1)) as j from found) group by r)
, named as (select r, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
        from (select distinct r, item_id from found) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(n.n, 0)::bigint as n_items,
       sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hits h using (r) left join named n using (r)
"""


def repair_sql() -> str:
    """DuckDB SQL of the conversation query: every row's cheapest continuation from each state of the grammar, last row first.

    A state's value is (cost, audit, lines); the smallest by cost and then audit is kept.
    """
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    # CRC-32 bit by bit: each byte is mixed in and shifted out eight times.
    steps = f"flatten(list_transform(range(1, strlen({key}) + 1), lambda p: [ord(({key})[p])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda c, o: case when o >= 0 then xor(c, o)
        else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end), 4294967295)"""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = "{'c': 1000000000::bigint, 'a': '', 'r': []::varchar[]}"

    def edit(cost: str, letter: str, line: str, to: str) -> str:
        rest = f"{to}.r" if not line else f"list_concat([{line}], {to}.r)"
        return f"{{'c': ({cost} + {to}.c)::bigint, 'a': '{letter}' || {to}.a, 'r': {rest}}}"

    role = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}   # written next, and the state after it
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    raw, closed = [], {}
    for q in range(4):
        kept = " ".join(f"when k = '{k}' then " + edit("trunc::int", "K", "role || ':' || text", f"s{to}") for k, to in keep[q].items())
        name, to = role[q]
        ways = [edit("3", "D", "", f"s{q}"), f"case when must_go then {far} {kept} else {far} end",
                f"case when must_go then {far} else " + edit("2 + trunc::int", "R", f"'{name}:' || text", f"s{to}") + " end"]
        raw.append(f"list_sort([{', '.join(ways)}])[1] as s{q}")
    insert = lambda q: f"list_sort([s{q}, {edit('2', 'I', repr(role[q][0] + ':'), f's{role[q][1]}')}])[1] as s{q}"
    step = f"select conv_id, i, {', '.join(raw)} from (select f.*, w.* exclude (conv_id, i) from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1)"
    for _ in range(3):
        step = f"select conv_id, i, {', '.join(insert(q) for q in range(4))} from ({step})"
    end = lambda c, a, r: f"{{'c': {c}::bigint, 'a': '{a}', 'r': {r}::varchar[]}}"
    return f"""with recursive t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as m from conversations)
, d as (select conv_id, turn, case when m = 4 then 'user' else role end as role,
        case m when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case m when 0 then []::int[] when 3 then [0, 1] else [0] end) as copy from t)
, o as (select *, left(role, 1) as k, rtrim(text, {blanks}) as v, row_number() over (partition by conv_id
        order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy) as i from d)
, g as (select *, v = '' as blank, v <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
        lag(k) over (partition by conv_id order by i) as before from o)
, f as (select *, blank or duplicate as must_go, not (blank or duplicate) and right(v, 1) not in ('.', '!', '?') as trunc from g)
, n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (trunc) as truncated,
        count(*) filter (i > 1 and before || k not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
, walk as (select conv_id, n + 1 as i, {end(0, '', '[]')} as s0, {end(4, 'II', "['user:', 'assistant:']")} as s1,
        {end(2, 'I', "['assistant:']")} as s2, {end(0, '', '[]')} as s3 from n
    union all {step})
select e.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank, coalesce(n.duplicate, 0)::bigint as duplicate,
       coalesce(n.truncated, 0)::bigint as truncated, coalesce(n.illegal, 0)::bigint as illegal, coalesce(w.s0.c, 0)::bigint as cost,
       coalesce(w.s0.a, '') as audit, sha256(coalesce(array_to_string(w.s0.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join n on n.conv_id is not distinct from e.conv_id
left join walk w on w.conv_id is not distinct from e.conv_id and w.i = 1"""


WORDS_SQL = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secret_scan": op2_secret_scan,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_nearest": op4_nearest,
    "op5_toxicity": op5_toxicity,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op10_mixing": mix_oracle("documents", "doc_id, lang, source", "coalesce(" + WORDS_SQL.format("text") + ", 0)",
                              MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    + "select doc_id, domain, lang, source, t::bigint as tokens, epoch::bigint as epoch from mixed",
    "op12_decontamination": DECONTAMINATION_SQL,
    "op13_conversation_repair": repair_sql(),
}
