"""The registered query of each operator over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import (
    bpe, html_text, language, merkle, neighbours, packing, prefixes, repeats, secret_scan, shards, simhash, token_files, top_k,
)
from graphloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.where("vec_id % 20 = 0"), 20)


@query()
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


@query()
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_files.token_records(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)
    return token_files.read_documents(token_files.written(records))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=0)
    return packing.pack(pieces)


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    e as (
        select doc_id, unnest([{'i': i, 'k': array_to_string(w[i:i + 12], ' ')} for i in range(1, len(w) - 11)]) as x from d
    ),
    f as (select doc_id, x.i as i, min(doc_id) over (partition by x.k) < doc_id as gone from e),
    g as (select distinct doc_id, i + j as p from f, range(13) t(j) where gone),
    v as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
    k as (
        select v.doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by v.p) filter (where g.p is null) as kept
        from v left join g on g.doc_id = v.doc_id and g.p = v.p group by 1
    )
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from d left join k on k.doc_id = d.doc_id
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
    with v as (
        select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
        where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    ),
    p as (
        select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
        from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
    ),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
    select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
""")
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


# The table of crc32 by byte, and the checksum of a list of bytes.
_CRC = """crc as (
        select list(r order by i) as k from (
            select i, list_reduce([i::bigint] || [0::bigint for z in range(8)],
                                  lambda a, b: case when a & 1 = 1 then xor(3988292384::bigint, a >> 1) else a >> 1 end) as r
            from range(256) t(i))
    )"""


def _crc32(data: str) -> str:
    return f"""xor(4294967295::bigint, list_reduce([4294967295::bigint] || {data}, lambda a, b: xor(k[(xor(a, b) & 255) + 1], a >> 8)))"""


def _digits(number: str) -> str:
    return f"[ord(c)::bigint for c in string_split(({number})::varchar, '')]"


def _bytes(text: str) -> str:
    return f"[('0x' || x)::bigint for x in regexp_extract_all(hex(encode({text})), '..')]"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar)::varchar || ':' || {column}::varchar, '-')"


@query(f"""
    with recursive {_CRC},
    d as (
        select doc_id, source, {' || '.join(map(_field, merkle.FIELDS[:-1]))} as fields, text,
               coalesce({_crc32(_digits('doc_id'))} % 5 = 0, false) as odd
        from documents, crc
    ),
    l as (
        select row_number() over (order by source nulls first, doc_id nulls first, sha256(fields || {_field('text')})) as id, doc_id, source,
               sha256(fields || {_field('text')}) as leaf, sha256(fields || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as low, odd
        from d
    ),
    -- Every level of the trees of the sources; up is the number of the parent.
    t as (
        select source, 0 as level, row_number() over (partition by source order by id) - 1 as pos, leaf as h from l
        union all
        select source, level, pos, h from (
            select source, level + 1 as level, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h, sum(count(*)) over (partition by source) as n
            from t group by source, level, pos // 16
        ) where n > 1
    ),
    s as (
        select source, arg_max(h, level) as subroot, max(level) as height from t where pos = 0 group by source
    ),
    u as (
        select 0 as level, row_number() over (order by source nulls first) - 1 as pos, subroot as h from s
        union all
        select level, pos, h from (
            select level + 1 as level, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h, sum(count(*)) over () as n
            from u group by level, pos // 16
        ) where n > 1
    ),
    r as (select arg_max(h, level) as root, max(level) as top from u where pos = 0),
    -- Siblings of every node, left and right of it.
    ts as (
        select source, level, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
               coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as b
        from t window w as (partition by source, level, pos // 16 order by pos)
    ),
    us as (
        select level, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
               coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as b
        from u window w as (partition by level, pos // 16 order by pos)
    ),
    n as (
        select l.*, s.subroot, s.height, root, row_number() over (partition by l.source order by id) - 1 as pos,
               dense_rank() over (order by l.source nulls first) - 1 as place
        from l join s on s.source is not distinct from l.source, r
    ),
    p as (
        select n.id, 0 as part, ts.level, a, b from n join ts on ts.source is not distinct from n.source and ts.pos = n.pos // (16 ** ts.level)::bigint
        where ts.level < n.height
        union all
        select n.id, 1, us.level, a, b from n join us on us.pos = n.place // (16 ** us.level)::bigint, r where us.level < top
    ),
    q as (
        select id, string_agg(a || b, '' order by part, level) as proof, list({{'a': a, 'b': b}} order by part, level) as steps from p group by id
    )
    select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256,
           list_reduce([{{'a': case when odd then low else leaf end, 'b': ''}}] || coalesce(steps, []),
                       lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a as folded_root,
           folded_root = root as verified
    from n left join q using (id)
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(read(spark, sf_dir, "documents")).drop("source")


def _wrapped(product: str) -> str:
    return f"({product}) % 18446744073709551616::uhugeint"


def _rotated(word: str, by: int) -> str:
    return f"({_wrapped(f'{word} * {1 << by}::uhugeint')} + ({word} // {1 << (64 - by)}::uhugeint))"


@query(f"""
    with recursive {_CRC},
    -- The 64-bit hash of the id (a null's is its seed).
    h0 as (
        select row_number() over (order by doc_id nulls first, text) as id, doc_id, text,
               {_wrapped('(doc_id::hugeint + 18446744073709551616::hugeint)::uhugeint')} as x from documents
    ),
    h1 as (select *, {_wrapped('x * 14029467366897019727::uhugeint')} as a from h0),
    h2 as (select *, xor(42::uhugeint + 2870177450012600261::uhugeint + 8, {_wrapped(_rotated('a', 31) + ' * 11400714785074694791::uhugeint')}) as b from h1),
    h3 as (select *, {_wrapped(_wrapped(_rotated('b', 27) + ' * 11400714785074694791::uhugeint') + ' + 9650029242287828579::uhugeint')} as c from h2),
    h4 as (select *, {_wrapped('xor(c, c // 8589934592::uhugeint) * 14029467366897019727::uhugeint')} as e from h3),
    h5 as (select *, {_wrapped('xor(e, e // 536870912::uhugeint) * 1609587929392839161::uhugeint')} as f from h4),
    h as (select id, doc_id, text, coalesce(xor(f, f // 4294967296::uhugeint), 42::uhugeint) as key from h5),
    j as (
        select id, key, -1::bigint as shard, 0::bigint as nxt from h
        union all
        select id, state, nxt, floor((nxt + 1) * (2147483648::double / ((state // 8589934592::uhugeint)::bigint + 1)))::bigint
        from (select id, nxt, {_wrapped('key * 2862933555777941757::uhugeint + 1')} as state from j where nxt < 16)
    ),
    s as (select id, max(shard) as shard, max(nxt) as nxt from j group by id),
    c as (
        select id, doc_id, strlen(coalesce(text, '')) + 1 as size, {_crc32(_bytes("coalesce(text, '')"))} as text_crc32 from h, crc
    )
    select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::integer as shard,
           row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot,
           (case when nxt = 16 then 16 else shard end)::integer as grown_shard
    from c join s using (id)
""")
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(read(spark, sf_dir, "documents"), 16)


@query(f"""
    with {_CRC},
    t as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (
                   partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
        from conversations where conv_id is not null
    ),
    c as (select conv_id, {_crc32(_digits('conv_id'))} % 6 as h from (select distinct conv_id from t), crc),
    r as (
        select c.conv_id, list({{'role': role, 'text': text}} order by part, pos) filter (where part is not null) as s
        from c left join (
            select c.conv_id, 0 as part, pos, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 and pos <= h
            union all
            select c.conv_id, 1, pos, role, text from c join t on t.conv_id = c.conv_id and pos > h
        ) x on x.conv_id = c.conv_id
        group by 1
    ),
    w as (select conv_id, coalesce(s, []) as s from r),
    n as (
        select s[1:d] as s, d, min(conv_id) as conv_id, count(*) as n_convs,
               coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(s) = d), '') as ends
        from w, range(len(s) + 1) x(d) group by 1, 2
    ),
    k as (select s[1:d - 1] as s, count(*) as n_children from n where d > 0 group by 1),
    m as (
        select n.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * length(s[d].text) end as saved
        from n left join k using (s)
    ),
    b as (
        select s[1:e] as s, e, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens
        from m, range(d + 1) x(e) group by 1, 2
    )
    select m.conv_id, m.d as depth, p.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::bigint as saved_tokens,
           sha256(m.ends) as ends_sha256
    from m join b on b.s = m.s left join m p on p.d = m.d - 1 and p.s = m.s[1:m.d - 1]
""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.nodes(read(spark, sf_dir, "conversations"))
