"""DuckDB SQL for the queries of this folder that SQL can state on whole tables."""

STATEMENTS = {
    "op2_exact_dedup": r"""
        with n as (
            select doc_id, length(coalesce(text, '')) as size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
            from documents),
        r as (
            select doc_id, norm, first_value(doc_id) over w as keep_id,
                   row_number() over w as place,
                   count(*) over (partition by norm) as group_size
            from n window w as (partition by norm order by size desc, doc_id nulls last))
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from r
    """,
    "op3_warc": r"""
        with p as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes,
                   sha1(coalesce(html, '')) as hex,
                   max(page_id) over (partition by coalesce(html, '')) as newest
            from pages)
        select page_id, payload_bytes,
               list_reduce(list_transform(range(32), lambda i: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int
                         >> (15 - 5 * (i % 4))::int) & 31), 1)), lambda a, b: a || b)
                   as payload_digest,
               case when page_id < newest then 'revisit' else 'response' end as record_type,
               case when page_id < newest then newest end as refers_to
        from p
    """,
    "op6_near_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                       lambda x: x <> '') as w
            from documents),
        sh as (
            select distinct doc_id, shingle from (
                select doc_id, unnest(case when len(w) > 1
                           then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                           when len(w) = 1 then w else [] end) as shingle
                from w)),
        n as (select doc_id, count(shingle) as n from w left join sh using (doc_id)
              group by doc_id),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as c
                   from sh a join sh b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b
                  where 100 * c >= 80 * (na.n + nb.n - c)),
        both_ways as (select a, b from links union all select b, a from links),
        reach(a, b) as (select doc_id, doc_id from n union
                        select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
        parts as (select a as doc_id, min(b) as component_id from reach group by a)
        select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
        from n join parts using (doc_id)
    """,
    "op9_decontamination": r"""
        with d as (
            select row_number() over () as r, doc_id,
                   list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from documents),
        b as (
            select item_id,
                   list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
            from benchmark),
        windows as (
            select distinct item_id, least(13, len(w)) as size,
                   array_to_string(w[s:s + least(13, len(w)) - 1], ' ') as words
            from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s
                  from b where len(w) > 0)),
        places as (
            select r, s, size, array_to_string(w[s:s + size - 1], ' ') as words
            from (select r, w, size, unnest(range(1, len(w) - size + 2)) as s
                  from d, (select distinct size from windows) where len(w) >= size)),
        found as (select r, item_id, s, size from places join windows using (size, words)),
        hit as (select r, count(distinct p) as n_hit
                from (select r, unnest(range(s, s + size)) as p from found) group by r),
        named as (select r, count(distinct item_id) as n_items,
                         string_agg(item_id::varchar, ',' order by item_id::varchar) as names
                  from (select distinct r, item_id from found) group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hit using (r) left join named using (r)
    """,
    "op10_mixing": r"""
        with recursive rows as (
            select doc_id, source, greatest(1, length(coalesce(text, '')))::bigint as n,
                   ('0x' || left(md5(coalesce(doc_id::varchar, text, '')), 8))::bigint as h
            from documents),
        sizes as (select source, sum(n)::bigint as chars,
                         (ceil(sum(n) / 65536.0))::bigint as blocks from rows group by source),
        t as (select count(*) as sources, sum(pow(chars::double, 0.9)) as raws from sizes),
        m as (select max(ceil(round(chars * raws / (65536.0::double
                  * greatest(pow(chars::double, 0.9), raws / 8192)), 6))) as need
              from sizes, t),
        p as (select sources, raws, greatest(4 * sources, least(8192, need))::bigint as period
              from t, m),
        g as (select s.*, p.*, greatest(pow(chars::double, 0.9), raws / 8192) as raw
              from sizes s, p),
        i as (select *, raw / sum(raw) over () * (period - sources) as ideal from g),
        q as (select *, floor(ideal)::bigint + 1 +
                     (row_number() over (order by round(ideal - floor(ideal), 9) desc,
                                         source nulls first)
                      <= period - sum(floor(ideal)::bigint + 1) over ())::bigint as q from i),
        w as (select *, row_number() over (order by q desc, source nulls first) as i,
                     max((blocks * period + q - 1) // q) over () as horizon from q),
        quota as (select list(q order by i) as quota, any_value(period) as period from w),
        plan(slot, pick, done) as (
            select -1::bigint, 0::bigint, list_transform(quota, lambda x: 0::bigint) from quota
            union all
            select slot + 1, best, list_transform(done, lambda x, k: x + (k = best)::bigint)
            from (select slot, done, list_position(options, list_min(options))::bigint as best
                  from (select slot, done, list_transform(done, lambda x, k:
                               case when x * period // quota[k] <= slot + 1
                                    then ((x + 1) * period + quota[k] - 1) // quota[k] end)
                               as options
                        from plan, quota where slot + 1 < period))),
        slots as (select pick as i, slot,
                         row_number() over (partition by pick order by slot) - 1 as nth
                  from plan where slot >= 0),
        placed as (
            select r.doc_id, r.source, w.*,
                   coalesce(sum(r.n) over (partition by r.source order by h, doc_id
                            rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from rows r join w on r.source is not distinct from w.source),
        played as (
            select *, epoch * blocks + start // 65536 as block
            from (select *, unnest(range(horizon // blocks + 1)) as epoch from placed)),
        timed as (
            select doc_id, played.source, epoch, block, start, horizon,
                   (block // q) * period + slots.slot as slot
            from played join slots on slots.i = played.i and slots.nth = block % q)
        select doc_id, source, epoch::int as epoch, block, slot, start from timed
        where slot < horizon
    """,
}
