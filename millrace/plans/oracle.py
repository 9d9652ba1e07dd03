"""Plain SQL for each registered query that SQL can express on the same tables."""

from __future__ import annotations

# Parameters of the registered queries, written out.
SEED, WIDTH, STRIDE = 42, 65, 64
LIMITS = (1, 60, 36000.0)
FIRST_MERGES = 24

# The lexer's rules once more, for an engine without possessive groups.
PIECES = (
    r"""(?s)(`[^`]*`?|"(?:\\["\\]|[^"\n])*"?|'(?:\\['\\]|[^'\n])*'?|//[^\n]*|/\*.*?(?:\*/|\z)"""
    r"""|[\p{L}_][\p{L}\p{Nd}_]*"""
    r"""|0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]*)?i?"""
    r"""|(?:0[oObB][0-9_]*|[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eEpP][+-]?[0-9_]*)?i?"""
    r"""|\.[0-9][0-9_]*(?:[eEpP][+-]?[0-9_]*)?i?"""
    r"""|&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|.)"""
)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Ids and names of tokens, written out here and not taken from the package under test.
TOKEN_NAMES = """
0 ILLEGAL  1 EOF  2 COMMENT  3 token(3)  4 IDENT  5 INT  6 FLOAT  7 IMAG  8 CHAR  9 STRING  10 token(10)
11 token(11)  12 +  13 -  14 *  15 /  16 %  17 &  18 |  19 ^  20 <<  21 >>  22 &^  23 +=  24 -=  25 *=  26 /=
27 %=  28 &=  29 |=  30 ^=  31 <<=  32 >>=  33 &^=  34 &&  35 ||  36 <-  37 ++  38 --  39 ==  40 <  41 >  42 =
43 !  44 !=  45 <=  46 >=  47 :=  48 ...  49 (  50 [  51 {  52 ,  53 .  54 )  55 ]  56 }  57 ;  58 :
59 token(59)  60 token(60)  61 break  62 case  63 chan  64 const  65 continue  66 default  67 defer  68 else
69 fallthrough  70 for  71 func  72 go  73 goto  74 if  75 import  76 interface  77 map  78 package  79 range
80 return  81 select  82 struct  83 switch  84 type  85 var  86 token(86)  87 token(87)  88 ~
"""
BLANKS = {89: ("SPACE", "' '"), 90: ("NEWLINE", "chr(10)"), 91: ("TAB", "chr(9)")}
BASIC_TYPES = (
    "int", "int8", "int16 ", "int32 ", "int64", "uint", "uint8", "uint16", "uint32", "uint64",
    "uintptr", "float32", "float64", "complex64", "complex128", "string", "bool", "byte", "rune",
)
AFTER = (
    ": , ; break default func interface select case defer go map struct chan else goto package "
    "switch const fallthrough if range type continue for import return var"
).split()
AROUND = ":= = && || >= <= > < != == - + * / % += -= *= /= %= << >>".split()
NAMED = [
    (int(number), name)
    for line in TOKEN_NAMES.split("\n")
    for number, name in (entry.split() for entry in line.split("  ") if entry)
]
UNSPELLED = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 59, 60, 86, 87)
DIM = "dim(tok_id, tok_name, tok_literal) as (values " + ", ".join(
    [f"({i}, {text(n)}, {text(n)})" for i, n in NAMED] + [f"({i}, {text(n)}, {l})" for i, (n, l) in BLANKS.items()]
) + ")"
SPELLED = "spelled(lit, sid) as (values " + ", ".join(
    [f"({text(n)}, {i})" for i, n in NAMED if i not in UNSPELLED] + [f"({l}, {i})" for i, (_, l) in BLANKS.items()]
) + ")"
TOKENS = f"""{DIM}, {SPELLED},
split as (select doc_id, lang, unnest(l) as lit, unnest(range(len(l))) as pos0 from (
  select doc_id, lang, regexp_extract_all(text, {text(PIECES)}, 1) as l from documents)),
placed as (select *, coalesce(sum(strlen(lit)) over (partition by doc_id order by pos0
  rows between unbounded preceding and 1 preceding), 0) as "start",
  sum(case when lit <> chr(13) then 1 else 0 end) over (partition by doc_id order by pos0) - 1 as pos
  from split),
tokens as (select doc_id, lang, cast(pos as integer) as pos, cast("start" as integer) as "start",
  cast("start" + strlen(p.lit) as integer) as "end", cast(case
  when sid is not null then sid
  when p.lit[1] in ('"', '`') then 9 when p.lit[1] = '''' then 8 when p.lit[1] = '/' then 2
  when regexp_matches(p.lit, '^[\\p{{L}}_]') then 4
  when p.lit[1] = '.' or p.lit[1] between '0' and '9' then case
    when p.lit like '%i' then 7
    when lower(p.lit[1:2]) = '0x' and regexp_matches(p.lit, '[.pP]') then 6
    when lower(p.lit[1:2]) <> '0x' and regexp_matches(p.lit, '[.eEpP]') then 6
    else 5 end
  else 0 end as integer) as tok_id,
  case when p.lit like '//%' then regexp_replace(p.lit, chr(13) || '$', '')
  when p.lit[1] in ('`', '/') then replace(p.lit, chr(13), '') else p.lit end as literal
  from placed p left join spelled s on s.lit = p.lit where p.lit <> chr(13))"""
SH = """c as (select doc_id, text as content, lang, source, row_number() over (order by doc_id) as rn
  from documents),
sh as (select *, cast((rn - 1) // 64 as integer) as shard_id from c)"""
WORDS = f"""{SH}, w as (select shard_id, rn, doc_id, string_split(content, ' ') as ids from sh),
off as (select *, cast(coalesce(sum(len(ids)) over (partition by shard_id order by rn
  rows between unbounded preceding and 1 preceding), 0) as bigint) as doc_offset from w),
stream as (select shard_id, doc_id, doc_offset + unnest(range(len(ids))) as gpos, unnest(ids) as token
  from off)"""
WINDOWS = f"""{WORDS}, len_s as (select shard_id, count(*) as n from stream group by 1),
starts as (select shard_id, unnest(range(0, greatest(n - {WIDTH}, 0), {STRIDE})) as start from len_s),
win as (select s.shard_id, s.start // {STRIDE} as win, s.start,
  list(t.token order by t.gpos) as ids from starts s join stream t
  on t.shard_id = s.shard_id and t.gpos >= s.start and t.gpos < s.start + {WIDTH} group by 1, 2, 3)"""
PADDED = f"""p0 as (select doc_id, string_split(text, ' ') as w from documents),
p1 as (select doc_id, w, unnest(range(0, len(w), {STRIDE})) as start from p0),
p2 as (select doc_id, start, w[start + 1 : start + {WIDTH}] as part from p1),
pad as (select doc_id, cast(start as integer) as start, cast(len(part) as integer) as n_real,
  case when len(part) < {WIDTH} then list_concat(part, list_transform(range({WIDTH} - len(part)),
  lambda i: '<pad>')) else part end as ids from p2)"""


def order(seed, *keys: str) -> str:
    return "md5(" + " || ':' || ".join([text(str(seed)), *[f"cast({k} as varchar)" for k in keys]]) + ")"


SPLIT = f"pos as (select doc_id, row_number() over (order by {order(SEED, 'doc_id')}) as pos, count(*) over () as n from documents)"
META = """ascii as (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as t from documents),
mw as (select doc_id, list_transform(case when t like ' %' then string_split(t, ' ')[2:] when t = '' then []
  else string_split(t, ' ') end, lambda w: '▁' || w) as words from ascii),
freq as (select word, count(*) as n from (select unnest(words) as word from mw) group by 1)"""
CURVES = """click as (select event_id as step, ts, value as loss, row_number() over (order by event_id) as rn
  from events where event_type = 'click'),
view_ as (select event_id as step, ts, value as loss, row_number() over (order by event_id) as rn
  from events where event_type = 'view')"""
CONCAT = f"""{CURVES}, cc as (select 0 as file_ordinal, step, loss, rn - 1 as "index" from click union all
  select 1, step, loss, rn - 1 + (select count(*) from click) from view_)"""
MET = """m as (select user_id % 8 as run_id, event_type as name, event_id as seq, value,
  1 + event_id % 7 as weight, ts, row_number() over (partition by user_id % 8 order by event_id) as step
  from events)"""
CAND = """cand as (select event_id // 10 as task_id, cast(event_id % 10 as integer) as candidate_id,
  case when event_type = 'error' then 1 else 0 end as build_rc,
  case when event_type = 'purchase' then 0 else 1 end as test_rc,
  event_type = 'signup' as timed_out, props as stderr, 'v := ' || cast(value as varchar) as code from events),
outc as (select task_id, candidate_id, build_rc = 0 as compiled,
  build_rc = 0 and not timed_out and test_rc = 0 as passed,
  case when not timed_out and (build_rc <> 0 or test_rc <> 0) then stderr end as error_log, code from cand),
cnt as (select task_id, sum(compiled::int)::bigint as num_compiled, sum(passed::int)::bigint as num_passed
  from outc group by 1)"""
LOSS = """tl as (select l_returnflag as dataset, l_orderkey % 200 as batch, l_linenumber as target,
  l_discount as loss from lineitem)"""
BATCH_LOSS = """coalesce(sum(loss) filter (target <> 1), 0.0)
  / (case when count(*) filter (target <> 1) = 0 then 1e-8 else count(*) filter (target <> 1) end)"""
PER_SOURCE = """ps as (select source, sum(len(string_split(text, ' ')))::bigint as tokens,
  count(*) as docs, sum(length(text))::bigint as chars from documents group by 1)"""
PREFIX = "(case {n} % 6 " + " ".join(f"when {i} then {{p{i}}}" for i in range(6)) + " end)"
PREFIXES = ["train/step/", "train/batch/", "validation/", "validation/batch/", "test/", "test/batch/"]


def phase_prefix(n: str) -> str:
    return "(case %s %% 6 %s end)" % (n, " ".join(f"when {i} then {text(p)}" for i, p in enumerate(PREFIXES)))


SIZES = "sz as (select o_orderkey, o_orderkey * o_orderkey * o_custkey * (o_custkey % 2 * 999 + 1) as n from orders)"


def unit(offset: int, digest: str) -> str:
    return f"(cast(('0x' || substr({digest}, {offset * 8 + 1}, 8)) as bigint) / 4294967296.0::double)"


def literal_digest(where: str) -> str:
    return f"""with {TOKENS}, f as (select doc_id, string_agg(literal, '|' order by pos) as s from tokens
    where {where} group by 1) select d.doc_id, md5(coalesce(s, '')) as digest from documents d left join f using (doc_id)"""


types = ", ".join(text(w) for w in BASIC_TYPES)
names_after = ", ".join(text(w) for w in AFTER)
names_around = ", ".join(text(w) for w in AROUND)

# Unicode white space, and the byte alphabet: printable bytes stand for themselves, others follow from U+0100.
SPACES = r"\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
GAP = "\ue0ff"
BYTE_SPLIT = (
    rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}{GAP}]+|[{SPACES}]+)"
)
BYTES = """bytes as (select list(case when b between 33 and 126 or b between 161 and 172 or b >= 174 then chr(b)
  else chr(256 + rank) end order by b) as letters from (select b, cast(row_number() over (
  partition by b between 33 and 126 or b between 161 and 172 or b >= 174 order by b) - 1 as integer) as rank
  from (select cast(unnest(range(256)) as integer) as b)))"""


def byte_words(source: str) -> str:
    """Words in byte symbols with their counts, from ``source(t)``.

    The last blank of a run goes to the next word: a mark before it stands for the pattern's look-ahead.
    """
    return f"""{BYTES}, led as (select case when t like ' %' then t else ' ' || t end as t from {source} where t <> ''),
    cut as (select regexp_replace(t, '([{SPACES}]+)([{SPACES}][^{SPACES}])', '\\1{GAP}\\2', 'g') as t from led),
    raw as (select w, count(*) as n from (select unnest(regexp_extract_all(t, {text(BYTE_SPLIT)}, 1)) as w from cut) group by 1),
    freq as (select array_to_string(list_transform(range(octet_length(encode(w))), lambda i:
    letters[cast(('0x' || substr(hex(encode(w)), cast(2 * i + 1 as bigint), 2)) as integer) + 1]), '') as word, n from raw, bytes)"""


def trained(merges: int = FIRST_MERGES, others: str = "select null as word where false") -> str:
    """Byte-pair training on freq(word, n), one merge a step: the commonest pair, ties by smaller ids.

    A symbol is one private character, so a merge is a replacement from the left. ``others`` are
    words that are merged along without counting; runs of their unknown characters are one symbol 0.
    """
    return f"""letters as (select distinct unnest(string_split(word, '')) as token from freq),
    alphabet as (select token, cast(2 + row_number() over (order by unicode(token)) as integer) as id from letters),
    given as (select word, n from freq union all select word, 0 from ({others}) where word not in (select word from freq)),
    spell as (select word, n, regexp_replace(translate(word, (select string_agg(token, '' order by id) from alphabet),
      (select string_agg(chr(57344 + id), '' order by id) from alphabet)), '[^\\x{{E000}}-\\x{{F8FF}}]+', chr(57344), 'g') as s from given),
    steps as (
      select 0 as step, false as is_token, word, n, s, cast(null as integer) as l, cast(null as integer) as r, cast(null as integer) as m from spell
      union all select 0, true, token, 0, chr(57344 + id), null, null, id from alphabet
      union all (
      with pairs as (select substr(s, i, 2) as pair, sum(n) as n from (select s, n, unnest(range(1, length(s))) as i
          from steps where not is_token and n > 0) group by 1),
        best as (select pair, unicode(pair) - 57344 as l, unicode(substr(pair, 2)) - 57344 as r
          from pairs order by pairs.n desc, pair limit 1),
        named as (select best.*, a.word || b.word as text from best join steps a on a.is_token and a.m = best.l
          join steps b on b.is_token and b.m = best.r),
        fresh as (select named.*, coalesce(k.m, (select max(m) from steps where is_token) + 1) as m, k.m is null as is_new
          from named left join steps k on k.is_token and k.word = named.text)
      select t.step + 1, t.is_token, t.word, t.n, case when t.is_token then t.s else replace(t.s, f.pair, chr(57344 + f.m)) end,
        f.l, f.r, case when t.is_token then t.m else f.m end from steps t, fresh f where t.step < {merges}
      union all select (select max(step) from steps) + 1, true, f.text, 0, chr(57344 + f.m), f.l, f.r, f.m
        from fresh f where f.is_new and (select max(step) from steps) < {merges})),
    last as (select * from steps where step = (select max(step) from steps)),
    tok as (select m as id, word as token from last where is_token),
    merges as (select distinct cast(step - 1 as integer) as rank, l, r, m from steps where step > 0 and not is_token),
    spelled_ids as (select word, list_transform(string_split(s, ''), lambda c: unicode(c) - 57344) as ids from last where not is_token)"""


MERGE_TABLE = """select rank, a.token as "left", b.token as "right", c.token as merged, l as left_id, r as right_id, m as merged_id
    from merges join tok a on a.id = l join tok b on b.id = r join tok c on c.id = m"""
ALL_WORDS = """raw_words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as place from (select doc_id,
  list_transform(case when text like ' %' then string_split(text, ' ')[2:] when text = '' then []
  else string_split(text, ' ') end, lambda w: '▁' || w) as w from documents))"""
ENCODED = f"""{META}, {ALL_WORDS}, {trained(others="select distinct word from raw_words")},
  id_lists as (select doc_id, flatten(list(ids order by place)) as ids from raw_words join spelled_ids using (word) group by 1),
  encoded as (select d.doc_id, coalesce(ids, []) as ids from documents d left join id_lists using (doc_id))"""


BEFORE_CURSOR = ENCODED.replace(
    "'▁' || w) as w from documents)", "'▁' || w) as w from (select doc_id, substr(text, 1, n_chars // 2) as text from documents))"
)


def lexed_words(where: str) -> str:
    """Words of the trainable literals of ASCII texts, in byte symbols."""
    stripped = "stripped as (select doc_id, lang, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as text from documents)"
    tokens = TOKENS.replace("from documents", "from stripped")
    return f"{stripped}, {tokens}, lits as (select literal as t from tokens where {where}), {byte_words('lits')}"


def shard_training(shards: int) -> str:
    """Word counts of the first shards only."""
    some = META.replace("from documents", f"from sh where shard_id < {shards}").replace("(text,", "(content,")
    return f"{SH}, {some}, {trained()}"


LEXED = lexed_words("tok_id in (2, 4, 5, 6, 7, 8, 9)")
TYPED = lexed_words(f"tok_id in (2, 4, 9) and literal not in ({types})")


def trained_size(words: str, extra: int) -> str:
    """Ids of a tokenizer after the first merges: special tokens, alphabet, merges, and those beside them."""
    return f"""(select cast({3 + extra} + count(*) as integer) from (with recursive {words}, {trained()} select token from tok))"""


ORACLE: dict[str, str] = {
    "corpus_scan": "select text as content from documents",
    "corpus_select": "select doc_id, text as content from documents where lang = 'en'",
    "jsonl_samples_scan": "select text as sample from documents",
    "jsonl_prompts_scan": "select text as description, 'pkg' || conv_id as package from conversations where turn = 0",
    "eval_tasks_scan": """select cast(conv_id as varchar) as task_id, text as prompt, 'pkg' || conv_id as test_setup,
        lower(text) as test from conversations where turn = 0""",
    "loss_csv_scan": """select case event_type when 'click' then 0 else 1 end as file_ordinal,
        cast(event_id as double) as step, epoch_us(ts) // 1000000 as timestamp, value as loss,
        row_number() over (partition by event_type order by event_id) - 1 as "offset"
        from events where event_type in ('click', 'view')""",
    "write_row_shards": f"""with {SH} select shard_id, printf('shard-%03d.parquet', shard_id) as file,
        count(*) as rows, sum(length(content))::bigint as chars from sh group by 1""",
    "token_shard_scan": f"with {SH} select shard_id, doc_id, content as text from sh",
    "token_summary": "select sum(len(string_split(text, ' ')))::bigint as num_tokens from documents",
    "append_jsonl": "select text as sample from conversations",
    "write_eval_summary": f"""with {CAND}, k as (select task_id, count(*)::int as n from outc group by 1)
        select task_id, n, num_compiled, num_passed from k join cnt using (task_id)""",
    "ascii_strip": "select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as content from documents",
    "strip_ws": "select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as content from documents",
    "truncate_after_marker": """select doc_id, case when strpos(text, '.' || chr(10)) > 0
        then substr(text, 1, strpos(text, '.' || chr(10)) + 1) else text end as content from documents""",
    "assemble_sources": """select conv_id, 'pkg' || conv_id || chr(10) || text as test_source,
        'package main' || chr(10) || chr(10) || text || 'pkg' || conv_id || chr(10) || chr(10) || 'func main() {}'
        as program from conversations where turn = 0""",
    "human_bytes": f"""with {SIZES} select o_orderkey, case when n < 1000 then n || ' B'
        when n < 1000000 then cast(n / 1e3::double as varchar) || ' KB'
        when n < 1000000000 then cast(n / 1e6::double as varchar) || ' MB'
        when n < 1000000000000 then cast(n / 1e9::double as varchar) || ' GB'
        else cast(n / 1e12::double as varchar) || ' TB' end as size from sz""",
    "human_count": f"""with {SIZES} select o_orderkey, case when n < 1000 then printf('%.0f', n::double)
        when n < 1000000 then printf('%.1fk', n / 1e3::double)
        when n < 1000000000 then printf('%.1fM', n / 1e6::double)
        else printf('%.1fB', n / 1e9::double) end as count from sz""",
    "metric_name_prefix": f"select event_id, {phase_prefix('event_id')} || event_type as path from events",
    "checkpoint_filename": """select event_id, printf('run-step=%d-loss=%.2f.pt', event_id, value / 7) as file
        from events where event_type <> 'signup'""",
    "metrics_to_string": """select l_orderkey, l_linenumber, l_partkey,
        'Test Loss: ' || printf('%.4f', l_discount / 7) || ', Test ' || upper(l_returnflag) || ': '
        || printf('%.4f', l_tax / 3) as line from lineitem""",
    "split_object_url": """with p as (select page_id, replace(url, 'https://', '') as u from pages),
        q as (select page_id, u, strpos(u, '/') as s from p)
        select page_id, case when s > 0 then substr(u, 1, s - 1) end as bucket,
        case when s > 0 then substr(u, s + 1) end as key,
        case when s > 0 then regexp_extract(substr(u, s + 1), '[^/]*$') end as base_name from q""",
    "chat_prompt_build": """with p as (select conv_id, 'New Snippet. Description: ' || text || ' Package: pkg' || conv_id
        as u from conversations where turn = 0)
        select conv_id, 0 as pos, 'system' as role, 'Write code.' as content from p union all
        select conv_id, 1, 'user', 'Example request' from p union all
        select conv_id, 2, 'assistant', 'Example answer' from p union all select conv_id, 3, 'user', u from p""",
    "package_prompt_build": """with p as (select conv_id, 'New Snippet. Package: pkg' || conv_id as u from conversations where turn = 0)
        select conv_id, 0 as pos, 'system' as role, 'Write code.' as content from p union all
        select conv_id, 1, 'user', 'Example request' from p union all
        select conv_id, 2, 'assistant', 'Example answer' from p union all select conv_id, 3, 'user', u from p""",
    "char_token_ratio": f"""with recursive {ENCODED} select doc_id, cast(printf('%.2f', length(text) / nullif(len(ids), 0)) as double)
        as ratio from documents join encoded using (doc_id)""",
    "tokens_of_type": f"""with {TOKENS}, f as (select doc_id, string_agg(literal, '|' order by pos) as s from tokens
        where tok_id = 5 group by 1)
        select d.doc_id, coalesce(s, '') as literals from documents d left join f using (doc_id)""",
    "literal_inner": f"""with {TOKENS} select doc_id, pos, case
        when tok_id = 2 and literal like '//%' then substr(literal, 3)
        else substr(literal, 2, greatest(length(literal) - 2, 0)) end as "inner" from tokens where tok_id in (2, 9)""",
    "go_lex": f"""with {TOKENS} select doc_id, count(*) as num_tokens, md5(string_agg(concat_ws(':', pos, "start",
        "end", t.tok_id, tok_name, literal), chr(10) order by pos)) as digest
        from tokens t join dim d on d.tok_id = t.tok_id group by 1""",
    "whitespace_fill": f"""with {TOKENS} select doc_id, count(*) filter (tok_id = 89) as spaces,
        count(*) filter (tok_id = 90) as newlines, count(*) filter (tok_id = 91) as tabs from tokens group by 1""",
    "newline_normalise": """select doc_id, length(text) - length(replace(text, chr(10), '')) as line_breaks
        from documents where text <> ''""",
    "token_dim_lookup": f"""with {DIM} select event_id, event_id % 100 as tok_id, coalesce(tok_name, 'UNKNOWN')
        as tok_name, coalesce(tok_literal, '') as tok_literal from events left join dim on event_id % 100 = dim.tok_id""",
    "trainable_literals": literal_digest("tok_id in (2, 4, 5, 6, 7, 8, 9)"),
    "typed_trainable_literals": literal_digest(f"tok_id in (2, 4, 9) and literal not in ({types})"),
    "token_kind_histogram": f"""with {TOKENS} select lang, tok_name, count(*) as n from tokens t
        join dim d on d.tok_id = t.tok_id group by 1, 2""",
    "pretok_metaspace": """with s as (select doc_id, case when text = '' then [] when text like ' %'
        then string_split(text, ' ')[2:] else string_split(text, ' ') end as l from documents)
        select doc_id, cast(len(l) as integer) as n_words,
        md5(array_to_string(list_transform(l, lambda w: '▁' || w), '|')) as digest from s""",
    "word_freq": f"with {META} select word, n from freq",
    "bpe_top_pairs": f"""with {META}, pos as (select word, n, unnest(range(1, length(word))) as i from freq)
        select substr(word, i, 2) as pair, sum(n)::bigint as n from pos group by 1""",
    "vocab_build_first_merges": f"""with recursive {META}, {trained()} select token, id,
        case when length(token) > 1 then 'merge' else 'alphabet' end as kind from tok union all
        select * from (values ('[UNK]', 0, 'special'), ('[PAD]', 1, 'special'), ('[EOS]', 2, 'special'))""",
    "bpe_decode": """select doc_id, case when text like ' %' then substr(t, 2) else t end as decoded from (
        select doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as t from documents)""",
    "roundtrip_status": """with t as (select lang, text, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as t from documents)
        select lang, avg((case when text like ' %' then substr(t, 2) else t end = text)::int) as success_rate
        from t group by 1""",
    "special_token_lookup": f"""select token, id, 0 as metaspace_extra, 103 as go_extra, 112 as typed_extra,
        {trained_size(META, 0)} as metaspace_size, {trained_size(LEXED, 103)} as go_size, {trained_size(TYPED, 112)} as typed_size
        from (values ('[UNK]', 0), ('[PAD]', 1), ('[EOS]', 2)) s(token, id)""",
    "id_to_token_name": f"""with {DIM} select event_id, case when g >= 92 then 'NL_INDENT_' || (g - 92)
        when tok_name in ({names_after}) then tok_name || '_'
        when tok_name in ({names_around}) then '_' || tok_name || '_' else tok_name end as name
        from (select event_id, event_id % 100 as g from events) e left join dim on g = dim.tok_id""",
    "train_shard_chunks": f"""with {SH} select shard_id, (rn - 1) % 64 // 16 as chunk, count(*) as rows,
        shard_id < 1 as used from sh group by 1, 2""",
    "train_first_shard_first_merges": f"with recursive {shard_training(1)} {MERGE_TABLE}",
    "train_two_shards_first_merges": f"with recursive {shard_training(2)} {MERGE_TABLE}",
    "shard_word_counts": f"""with {SH} select shard_id, word, count(*) as n from (select shard_id, unnest(list_transform(
        case when t like ' %' then string_split(t, ' ')[2:] when t = '' then [] else string_split(t, ' ') end,
        lambda w: '▁' || w)) as word from (select shard_id, regexp_replace(content, '[^\\x00-\\x7F]', '', 'g') as t from sh)) group by 1, 2""",
    "bpe_train_first_merges": f"with recursive {META}, {trained()} {MERGE_TABLE}",
    "bpe_train_lexed_first_merges": f"with recursive {lexed_words('tok_id in (2, 4, 5, 6, 7, 8, 9)')}, {trained()} {MERGE_TABLE}",
    "bpe_train_typed_first_merges":
        f"with recursive {lexed_words(f'tok_id in (2, 4, 9) and literal not in ({types})')}, {trained()} {MERGE_TABLE}",
    "bpe_encode_first_merges": f"with recursive {ENCODED} select doc_id, array_to_string(ids, ' ') as ids from encoded",
    "pretok_bytelevel": f"with {byte_words('(select text as t from documents)')} select word, n from freq",
    "write_token_shards_first_merges": f"""with recursive {SH}, {ENCODED} select shard_id, count(*) as documents,
        sum(len(ids))::bigint as num_tokens, (select sum(len(ids)) from encoded)::bigint as summary_tokens
        from sh join encoded using (doc_id) group by 1""",
    "stream_context_ids_first_merges": f"""with recursive {BEFORE_CURSOR}
        select md5((n_chars // 2) || ':' || text) as request_id,
        array_to_string(case when len(ids) > 40 then ids[len(ids) - 39 : len(ids)] else ids end, ' ') as context
        from documents join encoded using (doc_id)""",
    "stream_tokenize_first_merges": f"""with recursive {SH}, {ENCODED} select shard_id, count(*) as documents,
        sum(len(ids))::bigint as num_tokens, (select sum(len(ids)) from encoded)::bigint as total_tokens
        from sh join encoded using (doc_id) group by 1""",
    "doc_token_counts": f"""with {SH} select shard_id, doc_id, sum(len(string_split(content, ' ')))::bigint as num_tokens
        from sh group by rollup (shard_id, doc_id)""",
    "flatten_tokens": f"""with {WORDS} select shard_id, doc_id, min(gpos) as first_pos, max(gpos) as last_pos,
        md5(string_agg(token, ' ' order by gpos)) as digest from stream group by 1, 2""",
    "window_strict": f"""with {WINDOWS} select shard_id, win, start, array_to_string(ids, ' ') as text from win""",
    "window_padded": f"""with {PADDED} select doc_id, start, n_real, array_to_string(ids, ' ') as text from pad""",
    "shuffle_global": f"with {SPLIT} select doc_id, pos from pos",
    "shuffle_buffered": f"""with {WINDOWS}, size_s as (select shard_id, count(*) as n from win group by 1),
        grp as (select shard_id, (sum(n) over (order by {order(SEED, 'shard_id')}) - n) // 500 as g from size_s)
        select w.shard_id, w.win, g::bigint as buffer_group, row_number() over (order by g, {order(SEED, 'w.shard_id', 'w.win')})
        as pos from win w join grp on grp.shard_id = w.shard_id""",
    "batch_assign": f"""with {SPLIT} select doc_id, pos, (pos - 1) // 16 as batch_id from pos
        where ((pos - 1) // 16 + 1) * 16 <= n""",
    "batch_assign_keep_last": f"with {SPLIT} select doc_id, pos, (pos - 1) // 16 as batch_id from pos",
    "accum_step_assign": f"""with {SPLIT} select doc_id, (pos - 1) // 16 as batch_id, (pos - 1) // 64 as step from pos
        where ((pos - 1) // 64 + 1) * 4 <= n // 16""",
    "split_exact": f"""with {SPLIT} select doc_id, pos, case when pos <= floor(n * 0.9::double) then 'train'
        else 'validation' end as split from pos""",
    "shift_targets": f"""with {WINDOWS} select shard_id, win, array_to_string(ids[1:{WIDTH - 1}], ' ') as inputs,
        array_to_string(ids[2:{WIDTH}], ' ') as targets from win""",
    "pad_mask": f"""with {PADDED} select doc_id, start,
        array_to_string(list_transform(ids[1:{WIDTH - 1}], lambda x: case when x <> '<pad>' then '1' else '0' end), '') as attention_mask,
        array_to_string(list_transform(ids[2:{WIDTH}], lambda x: case when x <> '<pad>' then '1' else '0' end), '') as loss_mask from pad""",
    "left_truncate_context": """with r as (select doc_id, string_split(substr(text, 1, n_chars // 2), ' ') as w from documents)
        select doc_id, array_to_string(case when len(w) > 40 then w[len(w) - 39 : len(w)] else w end, ' ') as context from r""",
    "completion_budget": """select conv_id, cast(least(128, 512 - len(string_split(text, ' '))) as integer) as budget
        from conversations where turn = 0""",
    "quarantine_failures": """select case when l.doc_id is null then 'malformed' else 'ok' end as reason, count(*) as n
        from documents d left join labels l using (doc_id) group by 1""",
    "sample_rows": f"select doc_id, text as content from documents order by {order(SEED, 'doc_id')} limit 50",
    "draw_with_replacement": f"""with d as (select doc_id, row_number() over (order by doc_id) as rn, count(*) over () as n
        from documents), c as (select conv_id || '-' || turn as draw from conversations),
        r as (select draw, cast(('0x' || substr({order(SEED, 'draw')}, 1, 12)) as bigint) % (select count(*) from documents) + 1 as rn from c)
        select draw, doc_id from r join d using (rn)""",
    "review_filter": """select d.doc_id, text as content from documents d left join labels l using (doc_id)
        where coalesce(case when quality = 0 then 'n' else 'y' end, '') <> 'n'""",
    "resume_offset": """select conv_id, text as description, 'pkg' || conv_id as package from conversations where turn = 0
        and conv_id not in (select conv_id from conversations where turn = 5)""",
    "prompt_plan": f"""with d as (select conv_id as draw, {order(SEED, 'conv_id')} as h from conversations where turn = 0),
        names as (select list(lower(n_name) order by lower(n_name)) as l from nation),
        p as (select draw, h, l[cast(floor({unit(0, 'h')} * len(l)) as int) + 1] as name from d, names)
        select draw, case when {unit(1, 'h')} < 0.8 then name else name || '_test' end as package,
        round(0.3::double + (1.2::double - 0.3::double) * {unit(2, 'h')}, 9) as temperature, 2 as n_samples from p""",
    "described_prompt_plan": f"""with d as (select conv_id as draw, {order(SEED, 'conv_id')} as h from conversations where turn = 0),
        names as (select list(lower(n_name) order by lower(n_name)) as l from nation),
        p as (select draw, h, l[cast(floor({unit(0, 'h')} * len(l)) as int) + 1] as name from d, names)
        select draw, case when {unit(1, 'h')} < 0.8 then name else name || '_test' end as package,
        round(0.2::double + (0.6::double - 0.2::double) * {unit(2, 'h')}, 9) as temperature, 2 as n_samples from p""",
    "explode_choices": """select conv_id || '-' || turn as response_id, 0 as choice,
        trim(text, ' ' || chr(9) || chr(10) || chr(13)) as sample from conversations
        union all select conv_id || '-' || turn, 1, role from conversations""",
    "validation_registry": f"""with o as (select source as name, doc_id, row_number() over (order by {order(SEED, 'doc_id')}) as pos,
        count(*) over () as n from documents where source = 'src0')
        select name, doc_id from o where pos > floor(n * 0.9::double)
        union all select source, doc_id from documents where source <> 'src0'""",
    "shard_progress": f"""with {SH} select shard_id, doc_id, count(*) over w as rows_so_far,
        cast(sum(length(content)) over w as bigint) as chars_so_far from sh
        window w as (partition by shard_id order by rn)""",
    "stop_token_flag": f"""with {PADDED} select doc_id, start, coalesce(list_filter(ids, lambda x: x <> '<pad>')[-1], ids[1])
        in ('the', 'de') as stop from pad""",
    "strip_prompt_ids": """with w as (select doc_id, string_split(text, ' ') as l from documents)
        select doc_id, array_to_string(l[len(l) // 2 + 1 :], ' ') as rest from w""",
    "candidate_count_check": """select user_id as task_id, count(*) as n_candidates from events group by 1
        having count(*) <> 70""",
    "candidate_outcome": f"with {CAND} select * from outc",
    "task_counts": f"with {CAND} select * from cnt",
    "task_rates": f"with {CAND} select task_id, num_passed / 10 as pass_rate, num_compiled / 10 as compile_rate from cnt",
    "pass_at_k": f"""with {CAND} select 10 as k, round(avg((num_passed > 0)::int), 9) as pass_at_k,
        round(avg((num_compiled > 0)::int), 9) as compile_at_k from cnt""",
    "eval_summary_nested": f"""with {CAND} select task_id, string_agg(concat_ws('/', candidate_id,
        compiled, passed, coalesce(error_log, '-'), code), ';' order by candidate_id) as candidates,
        any_value(num_compiled) as num_compiled, any_value(num_passed) as num_passed
        from outc join cnt using (task_id) group by 1""",
    "masked_loss": f"""with {LOSS} select dataset, batch, round({BATCH_LOSS}, 10) as loss, count(*) as n_targets
        from tl group by 1, 2""",
    "dataset_val_loss": f"""with {LOSS}, bl as (select dataset, batch, {BATCH_LOSS} as loss from tl group by 1, 2)
        select dataset, round(avg(loss), 10) as loss, count(*) as n_batches from bl group by 1""",
    "weighted_mean": """select event_type as name, round(sum(value * (1 + event_id % 7)) / sum(1 + event_id % 7), 6) as mean,
        sum(1 + event_id % 7)::bigint as weight from events group by 1""",
    "step_loss_mean": f"""with {LOSS}, bl as (select batch, {BATCH_LOSS} as loss from tl group by 1)
        select batch // 8 as step, round(avg(loss), 10) as loss from bl where (batch // 8 + 1) * 8 <= 200 group by 1""",
    "tokens_ingested": f"""with {MET} select run_id, seq, cast(sum(weight) over (partition by run_id order by seq) as bigint)
        as total_tokens_ingested from m""",
    "rolling_mean": f"""with {CURVES} select step, round(case when count(loss) over w = 512 then avg(loss) over w end * 512, 2)
        as smoothed_loss_x512 from click window w as (order by rn rows between 511 preceding and current row)""",
    "curve_concat": f"with {CONCAT} select * from cc",
    "common_range": f"""with {CONCAT}, e as (select row_number() over (order by event_id) - 1 as "index", value as loss
        from events where event_type = 'error'), u as (select 'a' as curve, "index", loss from cc union all
        select 'b', "index", loss from e)
        select * from u where "index" <= least((select max("index") from cc), (select max("index") from e))""",
    "metric_series": f"""with {MET} select run_id, {phase_prefix('seq')} || name as path, step, value, seq from m
        where seq % 6 in (0, 1, 3, 5)""",
    "metric_latest": f"""with {MET}, l as (
        select run_id, {phase_prefix('seq')} || name as path, value, seq from m where seq % 6 in (2, 4)
        union all select run_id, 'train/steps', step::double, seq from m where seq % 6 = 0
        union all select run_id, 'train/batches', (step * 4)::double, seq from m where seq % 6 = 1
        union all select run_id, 'train/epochs', (step // 400)::double, seq from m)
        select run_id, path, max_by(value, seq) as value from l group by 1, 2""",
    "hyperparams_stringify": f"""with {MET}, kv as (select run_id, seq, 'name' as key, name as value from m union all
        select run_id, seq, 'value', cast(value as varchar) from m union all
        select run_id, seq, 'weight', cast(weight as varchar) from m)
        select run_id, key, max_by(value, seq) as value from kv group by 1, 2""",
    "step_elapsed_ms": f"""with {MET} select run_id, step,
        round((epoch_us(ts) - lag(epoch_us(ts)) over w) / 1000.0::double, 3) as step_ms,
        round((epoch_us(ts) - first_value(epoch_us(ts)) over (partition by run_id, step // 400 order by step))
        / 1000.0::double, 3) as since_epoch_ms from m window w as (partition by run_id order by step)""",
    "checkpoint_policy": f"""with recursive {MET}, s as (select run_id, seq, step // 400 as epoch, step,
        (epoch_us(ts) // 1000000)::double as seconds from m),
        fold as (select run_id, step as cur, seq, epoch, seconds, 0::bigint as le, 0::bigint as ls, seconds as lt,
        (epoch >= {LIMITS[0]} or step >= {LIMITS[1]}) as fired from s where step = 1
        union all select s.run_id, s.step, s.seq, s.epoch, s.seconds,
        case when f.fired then f.epoch else f.le end, case when f.fired then f.cur else f.ls end,
        case when f.fired then f.seconds else f.lt end,
        (s.epoch - case when f.fired then f.epoch else f.le end >= {LIMITS[0]}
         or s.step - case when f.fired then f.cur else f.ls end >= {LIMITS[1]}
         or s.seconds - case when f.fired then f.seconds else f.lt end >= {LIMITS[2]})
        from fold f join s on s.run_id = f.run_id and s.step = f.cur + 1)
        select run_id, seq, epoch, cur as step, seconds from fold where fired""",
    "retention_keep_n": f"""with {MET}, p as (select run_id, seq, row_number() over (partition by run_id order by seq desc) as r
        from m) select run_id, seq, case when r <= 3 then 'keep' else 'delete' end as action from p""",
    "compute_budget": f"""with {PER_SOURCE} select source, docs * 8 * 64 as tokens_per_batch,
        tokens * 1000 // (docs * 8 * 64) as total_steps from ps""",
    "expected_loss": f"""with {PER_SOURCE} select source, round(1.69::double + 406::double / pow((chars * 100)::double, 0.34::double)
        + 410.7::double / pow((tokens * 1000)::double, 0.27::double), 6) as expected_loss from ps""",
    "lr_time_budget": f"""with {MET}, clock as (select run_id, ts as t0 from m where step = 100)
        select m.run_id, step, round(case when step < 100 then step / 100::double
        else greatest(0.1::double, 1.0::double - (epoch_us(ts) - epoch_us(t0)) / 1e6::double / 1e6::double) end, 12) as lr_factor
        from m left join clock on clock.run_id = m.run_id""",
    "lr_onecycle": f"""with {MET}, n as (select run_id, step, (step - 1)::double as s, (count(*) over (partition by run_id))::double as total from m)
        select run_id, step, round(case when s <= 49.0::double
        then 0.01::double + (0.0004::double - 0.01::double) / 2 * (1 + cos(pi() * s / 49))
        else 0.000016::double + (0.01::double - 0.000016::double) / 2 * (1 + cos(pi() * (s - 49) / (total - 50))) end, 9) as lr from n""",
    "top_ops": """select l_suppkey, sum(round(l_quantity)::bigint)::bigint as total, count(*) as calls from lineitem
        group by 1 order by total desc, l_suppkey limit 10""",
    "param_summary": """with p as (select p_size::bigint * (p_partkey % 64 + 1) as n, p_size > 10 as tr from part),
        a as (select sum(n)::bigint as total, sum(case when tr then n else 0 end)::bigint as trainable,
        sum(case when tr then 0 else n end)::bigint as frozen from p)
        select *, case when total < 1000 then printf('%.0f', total::double)
        when total < 1000000 then printf('%.1fk', total / 1e3::double)
        when total < 1000000000 then printf('%.1fM', total / 1e6::double)
        else printf('%.1fB', total / 1e9::double) end as total_text from a""",
    "stream_context_requests": """with r as (select md5((n_chars // 2) || ':' || text) as request_id,
        string_split(substr(text, 1, n_chars // 2), ' ') as w from documents)
        select request_id, array_to_string(case when len(w) > 40 then w[len(w) - 39 : len(w)] else w end, ' ') as context from r""",
}
ORACLE["stream_weighted_mean"] = ORACLE["weighted_mean"]
ORACLE["stream_checkpoint_policy"] = ORACLE["checkpoint_policy"]
