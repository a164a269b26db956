"""DuckDB SQL fragments used by the oracle statements.

They restate, in plain SQL over the driver tables, what the Spark operators
compute, so that each registered query can be checked against an independent
engine.  The fixed values come from the same constants as the Spark side.
"""

from __future__ import annotations

from lexiflow.functions.arrays import BOS, EOS
from lexiflow.functions.text import PRETOKEN_PATTERN, WHITESPACE_CLASS
from lexiflow.operators import noise
from lexiflow.sources import fixtures as fx


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WHITESPACE_CLASS}+'), lambda x: x <> '')"


def pretokens(t: str) -> str:
    return f"regexp_extract_all({t}, '{PRETOKEN_PATTERN}')"


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0)"


def typo_word(w: str, row: str, pos: str, seed: int = fx.SEED) -> str:
    at = f"floor({uniform(str(seed), "'typo_at'", row, pos)} * length({w}))::int"
    return (f"(case when length({w}) >= {fx.TYPO_MIN_LEN} and {uniform(str(seed), "'typo'", row, pos)} < {fx.TYPO_RATE}::double "
            f"then substr({w}, 1, {at}) || substr({w}, {at} + 2) else {w} end)")


def pairs_cte(seed: int = fx.SEED) -> str:
    """pairs(row_id, path, hyp, ref) exactly as ``fixtures.pairs``."""
    u = uniform(str(seed), "'fail'", "doc_id")
    noisy = f"array_to_string(list_transform({words('text')}, lambda w, i: {typo_word('w', 'doc_id', 'i - 1', seed)}), ' ')"
    return f"""pairs as (
  select doc_id::bigint as row_id, '/root/' || source || '/' || doc_id::varchar as path,
         case when {u} < {fx.FAIL_NULL_RATE}::double then null
              when {u} < {fx.FAIL_NULL_RATE + fx.FAIL_BLANK_RATE}::double then '  '
              else {noisy} end as hyp,
         text as ref
  from documents)"""


def pseudo_cte(seed: int = fx.SEED) -> str:
    beam = (f"array_to_string(list_transform({words('text')}, lambda w, i: case when "
            f"{uniform(str(seed), "'beam'", 'doc_id', 'i - 1')} < {fx.BEAM_SUB_RATE}::double then 'zzz' else w end), ' ')")
    return f"""pseudo_base as (
  select '../root/' || source || '/' as output_dir, doc_id::varchar as audio_part_name, {beam} as beam, doc_id
  from documents where {uniform(str(seed), "'omit'", 'doc_id')} >= {fx.BEAM_OMIT_RATE}::double),
pseudo as (
  select output_dir, audio_part_name, beam from pseudo_base
  union all
  select output_dir, audio_part_name, beam from pseudo_base where {uniform(str(seed), "'dup'", 'doc_id')} < {fx.BEAM_DUP_RATE}::double)"""


def edit_distance(h: str, r: str) -> str:
    """Exact Levenshtein distance of two word lists (column names): an
    anti-diagonal DP folded with list_reduce.  Diagonal d holds the cells i (with
    j = d - i) inside the lists and at most k off the main diagonal, each from the
    two diagonals before it.  k = mismatches position by position + difference of
    lengths is a way to edit one list into the other, so no better way leaves the band."""
    n, m = f"len({h})", f"len({r})"
    k = f"(len(list_filter(range(1, least({n}, {m}) + 1), lambda q: {h}[q] <> {r}[q])) + abs({n} - {m}))::bigint"
    lo = f"greatest(0, d - {m}, (d - acc.k + 1) // 2)::bigint"
    return f"""(list_reduce(range(0, {n} + {m} + 1),
      lambda acc, d: {{'p2': acc.p1, 'o2': acc.o1, 'p1': list_transform(range({lo}, least({n}, d, (d + acc.k) // 2) + 1), lambda i:
          case when i = 0 then d
               when d - i = 0 then i
               else least(coalesce(acc.p1[i - 1 - acc.o1 + 1], 1000000000) + 1,
                          coalesce(acc.p1[i - acc.o1 + 1], 1000000000) + 1,
                          coalesce(acc.p2[i - 1 - acc.o2 + 1], 1000000000)
                            + case when {h}[i] = {r}[d - i] then 0 else 1 end) end), 'o1': {lo}, 'k': acc.k}},
      {{'p2': []::bigint[], 'o2': 0::bigint, 'p1': []::bigint[], 'o1': 0::bigint, 'k': {k}}}).p1[-1])"""


def alignment(h: str, r: str, bound: str, ops: bool = False) -> str:
    """Struct (d, s, x, n[, e]) of two lists (column names): distance, replaced, left-out and added items[, the errors as
    (op, i, j)], of the alignment that ``functions.align`` fixes.  The fold of ``edit_distance`` over cells that carry what
    the way to them holds; ``bound`` is any upper bound of the distance."""
    n, m = f"len({h})", f"len({r})"
    lo = f"greatest(0, d - {m}, (d - acc.k + 1) // 2)::bigint"
    e = ("e", "list<struct>") if ops else None
    kind = "struct(d bigint, s bigint, x bigint, n bigint" + (", e struct(op varchar, i bigint, j bigint)[]" if ops else "") + ")[]"
    diag, left, up = "acc.p2[i - 1 - acc.o2 + 1]", "acc.p1[i - acc.o1 + 1]", "acc.p1[i - 1 - acc.o1 + 1]"

    def cell(of, s, x, n_, op, i, j):
        err = f", 'e': {of}.e || [{{'op': '{op}', 'i': ({i})::bigint, 'j': ({j})::bigint}}]" if e else ""
        return f"{{'d': {of}.d + 1, 's': {of}.s + {s}, 'x': {of}.x + {x}, 'n': {of}.n + {n_}{err}}}"

    def edge(x, n_, op):
        err = (f", 'e': list_transform(range(0, d), lambda q: {{'op': '{op}', 'i': {'0::bigint' if op == 'D' else 'q::bigint'}, "
               f"'j': {'q::bigint' if op == 'D' else '0::bigint'}}})") if e else ""
        return f"{{'d': d::bigint, 's': 0::bigint, 'x': {x}::bigint, 'n': {n_}::bigint{err}}}"

    far = "1000000000"
    return f"""(list_reduce(range(0, {n} + {m} + 1),
      lambda acc, d: {{'p2': acc.p1, 'o2': acc.o1, 'p1': list_transform(range({lo}, least({n}, d, (d + acc.k) // 2) + 1), lambda i:
          case when i = 0 then {edge('d', '0', 'D')}
               when d - i = 0 then {edge('0', 'd', 'I')}
               when {h}[i] = {r}[d - i] then {diag}
               when coalesce({diag}.d, {far}) <= least(coalesce({left}.d, {far}), coalesce({up}.d, {far})) then {cell(diag, 1, 0, 0, 'S', 'i - 1', 'd - i - 1')}
               when coalesce({left}.d, {far}) <= coalesce({up}.d, {far}) then {cell(left, 0, 1, 0, 'D', 'i', 'd - i - 1')}
               else {cell(up, 0, 0, 1, 'I', 'i - 1', 'd - i')} end), 'o1': {lo}, 'k': acc.k}},
      {{'p2': []::{kind}, 'o2': 0::bigint, 'p1': []::{kind}, 'o1': 0::bigint, 'k': ({bound})::bigint}}).p1[-1])"""


def mismatches(h: str, r: str) -> str:
    """Places in which two lists differ, the longer one's rest included: an upper bound of their distance."""
    return f"(len(list_filter(range(1, least(len({h}), len({r})) + 1), lambda q: {h}[q] <> {r}[q])) + abs(len({h}) - len({r})))::bigint"


def turns_cte(seed: int = fx.SEED) -> str:
    """turns(conv_id, turn, h, r, k): the word lists of ``fixtures.noisy_turns`` and the number of changes made."""
    u = uniform(str(seed), "'turn'", "conv_id", "turn", "i - 1")
    at = f"floor({uniform(str(seed), "'turn_at'", 'conv_id', 'turn', 'i - 1')} * length(w))::int"
    head, ch, tail = f"substr(w, 1, {at})", f"substr(w, {at} + 1, 1)", f"substr(w, {at} + 2)"
    return f"""turns as (select conv_id, turn, r, len(list_filter(r, lambda w, i: {u} < {fx.TURN_ADD}::double)) as k, flatten(list_transform(r, lambda w, i:
    case when {u} < {fx.TURN_DROP}::double then []::varchar[]
         when {u} < {fx.TURN_DOUBLE}::double then [{head} || {ch} || {ch} || {tail}]
         when {u} < {fx.TURN_SWAP}::double then [{head} || 'e' || {tail}]
         when {u} < {fx.TURN_ADD}::double then [w, '{fx.TURN_FILLER}'] else [w] end)) as h
  from (select conv_id, turn, {words('text')} as r from conversations))"""


def aligned_pairs_ctes(rows: str) -> str:
    """wp(given, got, n) from ``rows`` with word lists h and r: aligned words, kept or replaced.

    Where two lists of one length differ in as many places as their distance, the fixed alignment is the one place by
    place (from the end on, the replacement or the equal pair is always a best way)."""
    return f"""al as (select *, {edit_distance('h', 'r')} as errors, {mismatches('h', 'r')} as mm from {rows}),
plainly as (select unnest(list_zip(r, h)) as z from al where len(h) = len(r) and errors = mm),
other as (select h, r, {alignment('h', 'r', 'mm', ops=True)}.e as e from al where not (len(h) = len(r) and errors = mm) and len(h) > 0 and len(r) > 0),
shifted as (select r[x.j + 1] as given, h[x.i + 1] as got from (select h, r, unnest(list_filter(e, lambda q: q.op = 'S')) as x from other)
  union all select w, w from (select unnest(list_filter(r, lambda w, i: not list_contains(list_transform(list_filter(e, lambda q: q.op <> 'I'), lambda q: q.j), i - 1))) as w from other)),
wp as (select given, got, count(*)::bigint as n from (select z[1] as given, z[2] as got from plainly union all select * from shifted) group by all)"""


def channel_ctes() -> str:
    """chan(given, got, n, total) from wp: counts of character steps."""
    chars = lambda w: f"regexp_extract_all({w}, '(?s).')"
    return f"""wc as (select given, got, n, {chars('given')} as r, {chars('got')} as h from wp),
we as (select given, got, n, h, r, {alignment('h', 'r', 'greatest(len(h), len(r))', ops=True)}.e as e from wc where given <> got),
st as (select c as given, c as got, n from (select unnest(r) as c, n from wc where given = got)
  union all select case when x.op = 'I' then '' else r[x.j + 1] end, case when x.op = 'D' then '' else h[x.i + 1] end, n from (select h, r, n, unnest(e) as x from we)
  union all select c, c, n from (select n, unnest(list_filter(r, lambda w, i: not list_contains(list_transform(list_filter(e, lambda q: q.op <> 'I'), lambda q: q.j), i - 1))) as c from we)
  union all select '', '', n * (len(r) + 1) from wc
  union all select '', '', -n from (select n, unnest(e) as x from we) where x.op = 'I'),
chan as (select given, got, n, sum(n) over (partition by given)::bigint as total from (select given, got, sum(n)::bigint as n from st group by all having sum(n) <> 0))"""


def word_ids(t: str) -> str:
    return (f"list_transform({words(t)}, lambda w: ({fx.ID_OFFSET} + "
            f"(('0x' || substr(md5(w), 1, 8))::bigint % {fx.ID_RANGE}))::int)")


def ids_cte() -> str:
    return f"ids as (select doc_id::bigint as row_id, {word_ids('text')} as ids from documents)"


def draws(n: str, length: str, seed: str, epoch: str, row: str, slot: str, lo, hi) -> str:
    pos = f"(1 + floor({uniform(seed, epoch, row, f"'{slot}_pos'", 'k')} * ({length} - 1)))::int"
    val = f"({lo} + floor({uniform(seed, epoch, row, f"'{slot}_val'", 'k')} * ({hi} - ({lo}) + 1)))::int"
    return f"list_transform(range(0, {n}), lambda k: {{'pos': {pos}, 'val': {val}}})"


def n_draws(length: str) -> str:
    return f"floor({noise.NOISE_RATE}::double * {length})::int"


def substitute(ids: str, seed: str, epoch: str, row: str) -> str:
    """The draws are bound once per row (a list of one list), then applied."""
    ds = draws(n_draws(f"len({ids})"), f"len({ids})", seed, epoch, row, "sub", noise.SUB_LO, noise.SUB_HI)
    return (f"list_transform([{ds}], lambda drawn: list_transform({ids}, lambda x, i: "
            f"coalesce(list_filter(drawn, lambda d: d.pos = i - 1)[-1].val, x)))[1]")


def insert(ids: str, length: str, seed: str, epoch: str, row: str) -> str:
    ds = draws(n_draws(length), length, seed, epoch, row, "ins", noise.INS_LO, noise.INS_HI)
    return f"list_reduce({ds}, lambda acc, d: acc[1:d.pos] || [d.val] || acc[d.pos + 1:], {ids})"


def corrupt(ids: str, seed: str, epoch: str, row: str) -> str:
    u = uniform(seed, epoch, row, "'mix'")
    mixed = (f"(case when {u} > {noise.MIX_LO}::double and {u} < {noise.MIX_HI}::double "
             f"then {substitute(ids, seed, epoch, row)} else {ids} end)")
    return f"([{BOS}] || {insert(mixed, f'len({ids})', seed, epoch, row)} || [{EOS}])"


def corpus_cte() -> str:
    return ("corpus as (select text from documents union all select text from benchmark "
            "union all select text from conversations)")


def bpe_learn_ctes(rounds: int) -> str:
    """Word counts, alphabet and ``rounds`` unrolled merge rounds.

    Defines words(word, n), alpha(ch), s0..s{rounds}(n, syms) and m0..m{rounds-1}
    (rank, l, r, merged).  Tie-break ids: a character's id is its code point, a
    learned token's id is 2**21 + the round that first produced it."""
    out = [corpus_cte(),
           f"words as (select w as word, count(*)::bigint as n from (select unnest({pretokens('text')}) as w from corpus) group by w)",
           "alpha as (select distinct unnest(regexp_extract_all(word, '(?s).')) as ch from words)",
           "s0 as (select n, regexp_extract_all(word, '(?s).') as syms from words where length(word) >= 2)"]
    for k in range(rounds):
        prior = " union all ".join(f"select merged, rank from m{j}" for j in range(k)) or \
            "select null::varchar as merged, null::int as rank where false"
        out.append(f"""pc{k} as (select p.l as l, p.r as r, sum(n)::bigint as cnt from (
    select n, unnest(list_transform(range(1, len(syms)), lambda i: {{'l': syms[i], 'r': syms[i + 1]}})) as p from s{k}
  ) group by all)""")
        out.append(f"tid{k} as (select merged as tok, 2097152 + min(rank) as id from ({prior}) group by merged)")
        out.append(f"""m{k} as (select {k} as rank, pc.l, pc.r, pc.l || pc.r as merged from pc{k} pc
  left join tid{k} a on a.tok = pc.l left join tid{k} b on b.tok = pc.r
  order by pc.cnt desc, coalesce(a.id, unicode(pc.l)), coalesce(b.id, unicode(pc.r)) limit 1)""")
        out.append(f"""s{k + 1} as (select n, case when list_contains(syms, m.l) and list_contains(syms, m.r) then
    list_reduce(syms, lambda acc, x: case when len(acc) > 0 and acc[-1] = m.l and x = m.r
                                     then acc[1:-2] || [m.merged] else acc || [x] end, []::varchar[])
    else syms end as syms from s{k}, m{k} m)""")
    return ",\n".join(out)


def bpe_vocab_ctes(rounds: int, specials) -> str:
    """After ``bpe_learn_ctes``: merges(rank, l, r, merged), vocab(id, token, special) and mm, one row with l{k}, r{k}, g{k} per merge."""
    spec = " union all ".join(f"select {i} as id, '{t}' as token, true as special" for i, t in enumerate(specials))
    cols = ", ".join(f"m{k}.l as l{k}, m{k}.r as r{k}, m{k}.merged as g{k}" for k in range(rounds))
    return f"""merges as ({" union all ".join(f"select rank, l, r, merged from m{k}" for k in range(rounds))}),
letters as (select ch as token from alpha where ch not in (select token from ({spec}))),
vocab as ({spec}
  union all select ({len(specials)} - 1 + row_number() over (order by unicode(token)))::int, token, false from letters
  union all select ({len(specials)} + (select count(*) from letters) - 1 + row_number() over (order by rank))::int, merged, false
    from (select merged, min(rank) as rank from merges group by merged) where merged not in (select token from letters)),
mm as (select {cols} from {', '.join(f'm{k}' for k in range(rounds))})"""


def bpe_words_cte(rounds: int, texts: str) -> str:
    """enc(w, toks, ids) of the distinct pre-tokens of ``texts`` (a query with one text column t), merges applied by rank."""
    syms = "regexp_extract_all(w, '(?s).')"
    for k in range(rounds):
        syms = (f"list_reduce({syms}, lambda acc, x: case when len(acc) > 0 and acc[-1] = l{k} and x = r{k} "
                f"then acc[1:-2] || [g{k}] else acc || [x] end, []::varchar[])")
    return f"""dw as (select distinct unnest({pretokens('t')}) as w from ({texts})),
cut as (select w, {syms} as toks from dw, mm),
enc as (select w, any_value(toks) as toks, list(coalesce(v.id, 0) order by y[1]) as ids
        from (select w, toks, unnest(list_zip(range(len(toks)), toks)) as y from cut) left join vocab v on v.token = y[2] group by w)"""


def split_ctes(fr=(0.6, 0.8)) -> str:
    """spl(row_id, path, hyp, ref, idx, split): positional split of the pairs
    with a hypothesis, by row id."""
    return f"""sp as (select row_id, path, hyp, ref, (row_number() over (order by row_id) - 1) as idx,
                 count(*) over () as n from pairs where hyp is not null),
spl as (select row_id, path, hyp, ref, idx, case when idx < floor({fr[0]}::double * n) then 'train'
            when idx < floor({fr[1]}::double * n) then 'valid' else 'test' end as split from sp)"""


def corrector_ctes(min_freq: int = 10) -> str:
    """fw(word, freq), bg(p, n, count), dix(key, pos, word), fixes(word, fix),
    corrected(row_id, corrected) for the pairs in ``spl``; fitted on train refs."""
    W = words
    return f"""fw as (select w as word, count(*)::bigint as freq from (select unnest({W('ref')}) as w from spl where split = 'train') group by w),
bg as (select z[1] as p, z[2] as n, count(*)::bigint as count from (
         select unnest(list_zip(['<s>'] || {W('ref')}, {W('ref')} || ['</s>'])) as z from spl where split = 'train')
       group by all),
dix as (select substr(word, 1, i) || substr(word, i + 2) as key, i as pos, word
        from (select word, unnest(range(length(word))) as i from fw)),
qw as (select distinct unnest({W('hyp')}) as word from spl),
unk as (select word from qw where word not in (select word from fw)),
qd as (select word, substr(word, 1, i) || substr(word, i + 2) as key, i as pos
       from (select word, unnest(range(length(word))) as i from unk)),
cand as (select distinct word, cand from (
           select u.word, d.word as cand from unk u join dix d on d.key = u.word
           union all select qd.word, f.word from qd join fw f on f.word = qd.key
           union all select qd.word, d.word from qd join dix d on d.key = qd.key and d.pos = qd.pos)
         where word <> cand),
ranked as (select c.word, c.cand, f.freq, count(*) over (partition by c.word) as n_cand,
                  row_number() over (partition by c.word order by f.freq desc, c.cand) as rn
           from cand c join fw f on f.word = c.cand),
fixes as (select word, cand as fix from ranked where rn = 1 and freq >= {min_freq} and n_cand = 1),
ct as (select row_id, unnest(list_zip(range(len({W('hyp')})), {W('hyp')})) as z from spl),
cw as (select ct.row_id, z[1] as i, coalesce(f.fix, z[2]) as w from ct left join fixes f on f.word = z[2]),
corrected as (select s.row_id, coalesce(string_agg(cw.w, ' ' order by cw.i), '') as corrected
              from spl s left join cw on cw.row_id = s.row_id group by s.row_id)"""
