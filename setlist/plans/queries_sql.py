"""The registered queries in DuckDB's SQL, written from their definitions: pairs by a plain join, folds by recursion."""

from __future__ import annotations

_NAME = r"""array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(coalesce(text,''),'\p{L}+')),lambda w: {'n':-length(w),'w':w})),1,2),lambda x: x.w),' ')"""
_DOCS = f"d AS MATERIALIZED (SELECT doc_id, coalesce(source,'') AS job_id, coalesce(lang,'') AS lang, {_NAME} AS name FROM documents)"
_EVENTS = _DOCS + """, e AS MATERIALIZED (SELECT job_id, doc_id::INT AS event_index,
  (doc_id%12+1)::VARCHAR||'.'||(doc_id%25+1)::VARCHAR||CASE WHEN doc_id%4=1 THEN '-'||(doc_id%25+3)::VARCHAR ELSE '' END AS date_text,
  CASE WHEN doc_id%6=1 THEN translate(name,'lo','10') WHEN doc_id%10=3 THEN name||' (live)' WHEN doc_id%7=3 THEN name||' & Guest' WHEN doc_id%11=5 THEN translate(name,'aeinrst','einrsta') ELSE name END AS performer,
  CASE WHEN doc_id%3=0 THEN '' ELSE lang END AS venue FROM d)"""
_ARTISTS = "a AS MATERIALIZED (SELECT job_id, doc_id::INT AS artist_ord, name, (doc_id%7+1)::INT AS song_count, 'song '||doc_id::VARCHAR AS song FROM d)"
_SUGGESTED = "s AS (SELECT job_id, doc_id::INT AS event_index, name AS artist_name, (['高','中','低'])[doc_id%3+1] AS confidence FROM d)"
_CLEAN = lambda c: rf"regexp_replace(regexp_replace(trim(regexp_replace({c},'\s+',' ','g')),'([一-鿿]) ([一-鿿])','\1\2','g'),' *([/&+×]) *','\1','g')"
_KEY = lambda c: rf"""regexp_replace(regexp_replace(translate(lower(strip_accents({_CLEAN(c)})),'丨|','ii'),'[&+]','and','g'),'[\s''"`.,:;!?()\[\]{{}}<>·•\-_/\\|（），。、！：；《》【】]','','g')"""
_RANGE = """r AS (SELECT *, split_part(split_part(date_text,'-',1),'.',1)::INT AS m, split_part(split_part(date_text,'-',1),'.',2)::INT AS d,
  CASE WHEN contains(date_text,'-') THEN split_part(date_text,'-',2)::INT END AS d2,
  [0,31,59,90,120,151,181,212,243,273,304,334] AS before, [31,28,31,30,31,30,31,31,30,31,30,31] AS len FROM e),
 o AS (SELECT *, CASE WHEN coalesce(d2,d)<=len[m] AND d<=len[m] THEN before[m]+d END AS s, CASE WHEN coalesce(d2,d)<=len[m] AND d<=len[m] THEN before[m]+coalesce(d2,d) END AS t FROM r)"""
_URL = r"regexp_extract(url,'^([a-zA-Z]+)://([^/?#]*)([^?#]*)'"


#: Aliases of all names in nm, and the features of names and aliases.
_ALIASES = rf"""nm AS (SELECT performer AS name FROM e UNION SELECT {_CLEAN('performer')} FROM e UNION SELECT name FROM a),
 l0 AS (SELECT name, unnest(list_concat([{{'o':0,'v':c}}], list_filter([{{'o':1,'v':b}}], lambda x: x.v<>c), list_transform(regexp_extract_all(c,'\(([^)]{{2,}})\)',1), lambda v, i: {{'o':1000+i,'v':v}}),
   list_transform(CASE WHEN regexp_matches(c,'(?i)[/、&+×]|\s+x\s+|嘉宾|feat|with|ft') AND NOT regexp_matches(c,'(?i)^belle\s*&\s*sebastian$') THEN regexp_split_to_array(regexp_replace(regexp_replace(c,'嘉宾[:：]?','/','g'),'(?i)\b(feat\.?|ft\.|with)\b','/','g'),'(?i)\s*(?:[/、&+×]|\s+x\s+)\s*') ELSE []::VARCHAR[] END, lambda v, i: {{'o':9000000+i,'v':v}}))) AS x
   FROM (SELECT name, c, trim(regexp_replace(c,'\([^)]*\)','','g')) AS b FROM (SELECT name, {_CLEAN('name')} AS c FROM nm))),
 l1 AS (SELECT name, x.o AS o, {_CLEAN('x.v')} AS value FROM l0),
 l2 AS (SELECT *, {_KEY('value')} AS key FROM l1 WHERE value<>''),
 l3 AS (SELECT *, row_number() OVER (PARTITION BY name, key ORDER BY o) AS k FROM l2 WHERE key<>''),
 al AS MATERIALIZED (SELECT name, row_number() OVER (PARTITION BY name ORDER BY o)-1 AS alias_ord, value FROM l3 WHERE k=1),
 n AS MATERIALIZED (SELECT *, translate(key,'1i0','llo') AS ocr, list_distinct(list_filter(list_transform(range(1,greatest(length(key),2)), lambda i: substr(key,i,2)), lambda g: g<>'')) AS grams,
   list_filter(list_distinct(regexp_extract_all(cf,'[a-z0-9一-鿿]+')), lambda w: w<>'and') AS words FROM (SELECT name, {_KEY('name')} AS key, replace(lower(name),'ß','ss') AS cf, regexp_matches(lower(strip_accents(name)),'[a-z]') AS latin, regexp_matches(name,'[一-鿿]') AS cjk,
   list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({_CLEAN('name')})),'[&+]',' and ','g'),'[^a-z0-9一-鿿]+'), lambda w: w NOT IN ('','and','the','live','concert','show','festival','上海','嘉宾','专场')) AS tokens FROM (SELECT name FROM nm UNION SELECT value FROM al)))"""


def _inside(x: str, y: str) -> str:
    return f"(CASE WHEN length({x}.key)<length({y}.key) THEN contains({y}.key,{x}.key) ELSE contains({x}.key,{y}.key) END)"


def _shorter(x: str, y: str) -> str:
    return f"(least(length({x}.key),length({y}.key))/greatest(length({x}.key),length({y}.key)))"


def _rule(x: str, y: str) -> str:
    """The number of the first rule that joins two names."""
    return f"""CASE WHEN {x}.key='' OR {y}.key='' THEN NULL WHEN {x}.key={y}.key THEN 1 WHEN {x}.ocr={y}.ocr AND length({x}.ocr)>=4 THEN 2
  WHEN ({x}.cjk OR {y}.cjk) AND least(length({x}.key),length({y}.key))>=2 AND {_inside(x, y)} AND {_shorter(x, y)}>=0.45 THEN 3
  WHEN NOT ({x}.cjk OR {y}.cjk) AND least(length({x}.key),length({y}.key))>=6 AND {_inside(x, y)} AND {_shorter(x, y)}>=0.62 THEN 4
  WHEN len({x}.tokens)>=2 AND len({y}.tokens)>=2 AND (CASE WHEN len({x}.tokens)<=len({y}.tokens) THEN list_has_all({y}.tokens,{x}.tokens) ELSE list_has_all({x}.tokens,{y}.tokens) END) THEN 5 END"""


def _spelling(a: str, b: str) -> str:
    most = f"(CASE WHEN least(length({a}),length({b}))<8 THEN 1 ELSE 2 END)"
    wrong = f"list_filter(range(1,length({a})+1), lambda i: substr({a},i,1)<>substr({b},i,1))"
    short, long = f"(CASE WHEN length({a})<length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a})<length({b}) THEN {b} ELSE {a} END)"
    taken = f"list_reduce(list_concat([{{'c':'','k':0}}],list_transform(string_split({long},''), lambda c: {{'c':c,'k':0}})), lambda s, x: {{'c':'','k':s.k+CASE WHEN substr({short},s.k+1,1)=x.c THEN 1 ELSE 0 END}}).k"
    slips = f"(length({a})+length({b})-2*{taken})"
    equal = f"(CASE WHEN len({wrong})=2 AND ({wrong})[2]=({wrong})[1]+1 AND substr({a},({wrong})[1],1)=substr({b},({wrong})[2],1) AND substr({a},({wrong})[2],1)=substr({b},({wrong})[1],1) THEN 1-1/length({a}) WHEN len({wrong})>{most} THEN 0 ELSE 1-len({wrong})/length({a}) END)"
    return f"(CASE WHEN {a}='' OR {b}='' THEN 0 WHEN {a}={b} THEN 1 WHEN abs(length({a})-length({b}))>{most} THEN 0 WHEN length({a})=length({b}) THEN {equal} WHEN {slips}>{most} THEN 0 ELSE 1-{slips}/greatest(length({a}),length({b})) END)::DOUBLE"


#: The tier and score of every event's aliases and every artist of its job, the best of each pair.
_TIERS = f"""tp AS (SELECT job_id, event_index, artist_ord, {_inside('x', 'y')} AS inside, {_shorter('x', 'y')} AS ratio, x.key AS k1, y.key AS k2, x.ocr AS o1, y.ocr AS o2, x.words AS w1, y.words AS w2, x.grams AS g1, y.grams AS g2
   FROM e JOIN al ON al.name=e.performer JOIN n x ON x.name=al.value JOIN a USING (job_id) JOIN n y ON y.name=a.name),
 ts AS (SELECT *, greatest({_spelling('k1', 'k2')},{_spelling('o1', 'o2')}) AS spelling FROM tp),
 tt AS (SELECT job_id, event_index, artist_ord, CASE WHEN k1<>'' AND k1=k2 THEN {{'t':6,'s':1.0::DOUBLE}} WHEN length(o1)>=4 AND o1=o2 THEN {{'t':5,'s':1.0::DOUBLE}} WHEN k1<>'' AND k2<>'' AND inside AND ratio>=0.6 THEN {{'t':4,'s':ratio::DOUBLE}}
   WHEN len(w1)>0 AND len(w2)>0 AND (list_has_all(w1,w2) OR list_has_all(w2,w1)) THEN {{'t':3,'s':(least(len(w1),len(w2))/greatest(len(w1),len(w2)))::DOUBLE}} WHEN spelling>0 THEN {{'t':2,'s':spelling}}
   ELSE {{'t':1,'s':coalesce(len(list_intersect(g1,g2))/nullif(len(list_distinct(list_concat(g1,g2))),0),0)::DOUBLE}} END AS r FROM ts),
 tier AS (SELECT job_id, event_index, artist_ord, max(r) AS r FROM tt GROUP BY ALL)"""
_SHORTLISTS = f"""WITH {_EVENTS}, {_ARTISTS}, {_ALIASES}, {_TIERS},
 every AS (SELECT e.job_id, e.event_index, a.artist_ord, a.name, coalesce(r, {{'t':0,'s':0::DOUBLE}}) AS r, y.key, y.cf FROM e JOIN a USING (job_id) JOIN n y ON y.name=a.name LEFT JOIN tier USING (job_id, event_index, artist_ord)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, event_index ORDER BY r.t DESC, r.s DESC, key, cf, artist_ord) AS rank FROM every),
 short AS (SELECT job_id, event_index, rank::INT AS rank, artist_ord, name, r.t::INT AS tier, r.s AS score FROM ranked WHERE rank<=5)"""

_FUZZY = f"""p AS (SELECT e.job_id, event_index, artist_ord, alias_ord, al.value, {_rule('x', 'y')} AS rule FROM e JOIN al ON al.name=e.performer JOIN n x ON x.name=al.value JOIN a USING (job_id) JOIN n y ON y.name=a.name),
 q AS (SELECT *, row_number() OVER (PARTITION BY job_id, event_index, artist_ord ORDER BY rule, alias_ord) AS k FROM p WHERE rule IS NOT NULL),
 f AS (SELECT job_id, event_index, artist_ord, ([1.0,0.94,0.9,0.88,0.87])[rule]::DOUBLE AS score, CASE WHEN rule=1 THEN '高' ELSE '中' END AS confidence, (['清洗后精确匹配','OCR 字形混淆匹配','中文包含匹配','英文包含匹配','英文 token 集合匹配'])[rule] AS method, value AS alias FROM q WHERE k=1)"""
_ANCHORS = """one AS (SELECT job_id, key, min(artist_ord) AS artist_ord FROM a JOIN n USING (name) WHERE key<>'' GROUP BY ALL HAVING count(*)=1),
 two AS (SELECT job_id, ocr, min(artist_ord) AS artist_ord FROM a JOIN n USING (name) WHERE key<>'' GROUP BY ALL HAVING count(*)=1),
 f1 AS (SELECT e.job_id, event_index, one.artist_ord FROM e JOIN n ON n.name=e.performer JOIN one ON one.job_id=e.job_id AND one.key=n.key),
 anchor AS (SELECT * FROM f1 UNION ALL SELECT e.job_id, event_index, two.artist_ord FROM e JOIN n ON n.name=e.performer JOIN two ON two.job_id=e.job_id AND two.ocr=n.ocr WHERE latin AND length(n.key)>=4 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.job_id=e.job_id AND f1.event_index=e.event_index))"""


def _suggestions(left: str, taken: str, label: str) -> str:
    """Suggestions for events that `taken` has not, for the first artist of `left` with the suggested key."""
    return f"""SELECT s.job_id, s.event_index, min(l.artist_ord) AS artist_ord, CASE WHEN confidence='高' THEN 0.84 ELSE 0.76 END::DOUBLE AS score, confidence, 'AI{label}：same words' AS method, artist_name AS alias
  FROM s JOIN n sn ON sn.name=s.artist_name JOIN (SELECT job_id, artist_ord, key FROM {left} JOIN n USING (name)) l ON l.job_id=s.job_id AND l.key=sn.key
  WHERE sn.key<>'' AND confidence<>'低' AND NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.job_id=s.job_id AND t.event_index=s.event_index) GROUP BY ALL"""


def _report(found: str) -> str:
    """The numbered report as `report`; `found`: CTEs up to m0, the matches (origin, job_id, event_index, artist_ord, score, confidence, method, alias)."""
    same = lambda x, y: f"SELECT al.name AS one, w.name AS other FROM al JOIN n x ON x.name=al.value, n w WHERE w.name IN (SELECT name FROM nm) AND {_rule('x', 'w')} IS NOT NULL".replace("x ON", f"{x} ON").replace("x.", f"{x}.")
    return f"""WITH RECURSIVE {_EVENTS}, {_ARTISTS}, {_SUGGESTED}, {_ALIASES}, {_RANGE}, {found},
 m AS MATERIALIZED (SELECT m0.*, e.date_text, {_CLEAN('e.performer')} AS performer, e.venue, a.name AS artist_name, a.song_count, a.song, o.m, o.d, o.d2, o.s, o.t, coalesce(o.t-o.s+1,1) AS days, n.key AS akey, CASE m0.confidence WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END AS conf
   FROM m0 JOIN e USING (job_id, event_index) JOIN a USING (job_id, artist_ord) JOIN o USING (job_id, event_index) JOIN n ON n.name=a.name),
 g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id, akey ORDER BY days DESC, score DESC, conf DESC, venue='', song_count DESC, origin, event_index, artist_ord) AS rn FROM m),
 k AS (SELECT job_id, akey, rn, [{{'s':s,'t':t,'rn':rn}}] AS kept FROM g WHERE rn=1
   UNION ALL SELECT g.job_id, g.akey, g.rn, CASE WHEN len(list_filter(kept, lambda x: x.s<=g.t AND g.s<=x.t))>0 THEN kept ELSE list_append(kept, {{'s':g.s,'t':g.t,'rn':g.rn}}) END FROM k JOIN g ON g.job_id=k.job_id AND g.akey=k.akey AND g.rn=k.rn+1),
 z AS MATERIALIZED (SELECT g.* FROM g JOIN (SELECT job_id, akey, max_by(kept, rn) AS kept FROM k GROUP BY ALL) l USING (job_id, akey) WHERE list_contains(list_transform(kept, lambda x: x.rn), g.rn)),
 there AS (SELECT e.job_id, e.performer, e.venue, e.event_index, o.s, o.t FROM e JOIN o USING (job_id, event_index) WHERE e.venue<>''),
 who AS (SELECT job_id, event_index, artist_ord, s, t, unnest([performer, artist_name]) AS name FROM z WHERE venue=''),
 close AS MATERIALIZED (SELECT DISTINCT w.job_id, w.event_index, w.artist_ord, th.event_index AS their, th.venue, th.t-th.s AS days, w.name, th.performer FROM who w JOIN there th ON th.job_id=w.job_id AND w.s<=th.t AND th.s<=w.t),
 names AS MATERIALIZED (SELECT DISTINCT name, performer FROM close),
 alike AS (SELECT DISTINCT c.name, c.performer FROM names c JOIN n w ON w.name=c.name JOIN n v ON v.name=c.performer LEFT JOIN al x1 ON x1.name=c.name LEFT JOIN n x ON x.name=x1.value LEFT JOIN al y1 ON y1.name=c.performer LEFT JOIN n y ON y.name=y1.value
   WHERE w.key<>'' AND v.key<>'' AND (w.key=v.key OR ({_rule('x', 'v')}) IS NOT NULL OR ({_rule('y', 'w')}) IS NOT NULL OR (w.cjk OR v.cjk) AND least(length(w.key),length(v.key))>=2 AND {_inside('w', 'v')})),
 fill AS (SELECT job_id, event_index, artist_ord, arg_min(venue, {{'d':-days,'e':their}}) AS venue FROM close JOIN alike USING (name, performer) GROUP BY ALL HAVING count(DISTINCT venue)=1),
 report AS (SELECT z.job_id, row_number() OVER (PARTITION BY z.job_id ORDER BY m*100+d, performer, score DESC, days DESC, conf DESC, z.venue='', song_count DESC, origin, event_index, artist_ord)::INT AS index, date_text,
   m::VARCHAR||'月'||d::VARCHAR||'日'||CASE WHEN d2 IS NULL THEN '' ELSE '-'||d2::VARCHAR||'日' END AS date_display, performer, coalesce(fill.venue, z.venue) AS venue, artist_name, song_count AS playlist_song_count, song AS sample_songs, confidence, score, method AS match_method, alias AS matched_alias, '' AS image_name
   FROM z LEFT JOIN fill USING (job_id, event_index, artist_ord))"""


_RULES = _report(f"{_FUZZY}, m0 AS (SELECT 0 AS origin, * FROM f UNION ALL SELECT 0 AS origin, * FROM ({_suggestions('a', 'f', '候选补充')}))")
_ANCHORED = _report(
    f"""{_ANCHORS}, used AS (SELECT DISTINCT job_id, key FROM anchor JOIN a USING (job_id, artist_ord) JOIN n USING (name)), free AS (SELECT a.* FROM a JOIN n USING (name) WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.job_id=a.job_id AND used.key=n.key)),
 m0 AS (SELECT 0 AS origin, job_id, event_index, artist_ord, 1.0::DOUBLE AS score, '高' AS confidence, '精确名称锚定' AS method, {_CLEAN('performer')} AS alias FROM anchor JOIN e USING (job_id, event_index) UNION ALL SELECT 1 AS origin, * FROM ({_suggestions('free', 'anchor', '直接匹配')}))"""
)

_REVIEWED = _report(
    f"""{_FUZZY}, dc AS (SELECT job_id, doc_id::INT AS event_index, name, doc_id%5<>0 AS yes, (['高','中','低'])[(doc_id+1)%3+1] AS own FROM d),
 rv AS (SELECT f.job_id, f.event_index, f.artist_ord, score, CASE WHEN f.confidence<>'高' AND yes IS NOT NULL THEN own ELSE f.confidence END AS confidence, CASE WHEN f.confidence<>'高' AND yes IS NOT NULL THEN method||' + AI复核：seen' ELSE method END AS method, alias
   FROM f JOIN a USING (job_id, artist_ord) LEFT JOIN dc ON dc.job_id=f.job_id AND dc.event_index=f.event_index AND dc.name=a.name WHERE f.confidence='高' OR yes IS NULL OR yes),
 m0 AS (SELECT 0 AS origin, * FROM rv UNION ALL SELECT 0 AS origin, * FROM ({_suggestions('a', 'rv', '候选补充')}))"""
)

#: Letters and the Chinese characters that a view of Chinese names has in their place.
LATIN, CHINESE = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def _chinese(sql: str) -> str:
    """The same report on Chinese names, with the first three fifths of some for the look-alike digits."""
    return sql.replace(f"{_NAME} AS name", f"translate(lower({_NAME}),'{LATIN}','{CHINESE}') AS name").replace("translate(name,'lo','10')", "left(name,(length(name)*3+4)//5)")


#: Lines of the images: by order, each line item's own.
_LINES = r"""li AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey::VARCHAR AS p, floor(l_quantity)::INT AS q, l_linenumber*100.0::DOUBLE AS y FROM lineitem),
 ld AS (SELECT *, ((ln+0)%12+1)::VARCHAR||' / '||(q%28+1)::VARCHAR AS d0, ((ln+5)%12+1)::VARCHAR||' / '||(q%28+1)::VARCHAR AS d5, ((ln+7)%12+1)::VARCHAR||' / '||(q%28+1)::VARCHAR AS d7 FROM li),
 li8 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ln, d0, p) AS item FROM ld),
 lx AS (SELECT k, item, y, unnest(CASE WHEN k%4=3 THEN [{'o':0,'text':d0,'x1':20,'x2':90,'dy':0},{'o':1,'text':'周五','x1':120,'x2':160,'dy':0},{'o':2,'text':'Left '||p,'x1':205,'x2':350,'dy':1},{'o':3,'text':d5,'x1':390,'x2':460,'dy':0},{'o':4,'text':'Right '||p,'x1':575,'x2':650,'dy':2}]
   ELSE list_concat([{'o':0,'text':d0,'x1':16,'x2':83,'dy':0},{'o':1,'text':'Band '||p,'x1':418,'x2':703,'dy':3}],
    CASE k%4 WHEN 0 THEN [{'o':3,'text':'MAO','x1':943,'x2':1051,'dy':5}] WHEN 2 THEN [{'o':3,'text':'霏','x1':930,'x2':955,'dy':4},{'o':4,'text':'声','x1':956,'x2':990,'dy':4}]
     ELSE list_concat([{'o':2,'text':'-'||(q%28+3)::VARCHAR,'x1':135,'x2':182,'dy':2},{'o':3,'text':'星在2F','x1':943,'x2':1051,'dy':50}], CASE WHEN q%2=0 THEN [{'o':4,'text':d7,'x1':16,'x2':83,'dy':50}] ELSE list_filter([{'o':4,'text':d7,'x1':16,'x2':83,'dy':50}], lambda x: false) END) END) END) AS x FROM li8),
 sl AS MATERIALIZED (SELECT k, y+x.dy+10 AS cy, item*8+x.o AS line_ord, x.text AS text, x.x1 AS x1, x.x2 AS x2, regexp_matches(replace(x.text,' ',''),'^\d{1,2}/\d{1,2}$') AS dated, row_number() OVER (PARTITION BY k ORDER BY y+x.dy+10, item*8+x.o, x.text, x.x1, x.x2) AS rn FROM lx),
 rc AS (SELECT k, rn, 0 AS row, cy AS sum, 1 AS n FROM sl WHERE rn=1
   UNION ALL SELECT sl.k, sl.rn, CASE WHEN abs(sl.cy-sum/n)<=18 THEN row ELSE row+1 END, CASE WHEN abs(sl.cy-sum/n)<=18 THEN sum+sl.cy ELSE sl.cy END, CASE WHEN abs(sl.cy-sum/n)<=18 THEN n+1 ELSE 1 END FROM rc JOIN sl ON sl.k=rc.k AND sl.rn=rc.rn+1),
 t AS MATERIALIZED (SELECT sl.*, rc.row FROM sl JOIN rc USING (k, rn)),
 st AS MATERIALIZED (SELECT k, list(DISTINCT x1) AS starts FROM t WHERE dated GROUP BY k),
 pd AS (SELECT t.*, split_part(replace(text,' ',''),'/',1) AS mm, split_part(replace(text,' ',''),'/',2) AS dd FROM t WHERE dated),
 su AS (SELECT p.k, {'a':d.row,'b':d.x1,'c':d.rn,'d':p.rn} AS pl, d.mm||'.'||d.dd AS date_text, p.text AS performer, '' AS venue FROM pd d JOIN st USING (k) JOIN t p ON p.k=d.k AND p.row=d.row
   WHERE len(starts)>=2 AND p.x1>=d.x2+52 AND p.x1<coalesce(list_min(list_filter(starts, lambda s: s>d.x1+70)),1081)-16.2 AND regexp_matches(p.text,'^(Left|Right|Band) ')),
 pe AS (SELECT t.* FROM t LEFT JOIN st USING (k) WHERE coalesce(len(starts),0)<2 AND text LIKE 'Band %' AND x1>=210 AND x2<=910),
 ve AS (SELECT *, CASE WHEN text='声' THEN '霏声' ELSE text END AS name FROM t WHERE x1>=900 AND text IN ('MAO','星在2F','声')),
 ce AS (SELECT k, row, avg(cy) AS centre FROM t GROUP BY ALL),
 nv AS (SELECT p.k, p.rn, arg_min(v.name, {'f':abs(v.cy-p.cy),'r':v.rn}) FILTER (WHERE v.row=p.row) AS here, arg_min(v.name, {'f':abs(v.cy-p.cy),'r':v.rn}) FILTER (WHERE v.row=p.row+1 AND c.centre-p.cy BETWEEN 40 AND 72) AS gap FROM pe p LEFT JOIN ve v ON v.k=p.k AND v.row IN (p.row,p.row+1) LEFT JOIN ce c ON c.k=p.k AND c.row=p.row+1 GROUP BY ALL),
 lo AS (SELECT p.*, nv.here, nv.gap, CASE WHEN nv.here IS NULL AND nv.gap IS NOT NULL AND EXISTS (SELECT 1 FROM pd WHERE pd.k=p.k AND pd.row=p.row+1 AND pd.x1<110) THEN p.row+1 ELSE p.row END AS at_row FROM pe p JOIN nv USING (k, rn)),
 da AS (SELECT l.k, l.rn, arg_min({'m':d.mm,'d':d.dd}, {'f':abs(d.cy-l.cy),'r':d.rn}) AS date FROM lo l JOIN pd d ON d.k=l.k AND d.row=l.at_row AND d.x1<110 GROUP BY ALL),
 un AS (SELECT l.k, l.rn, arg_min(substr(u.text,2), {'f':abs(u.cy-l.cy),'r':u.rn}) AS until FROM lo l JOIN t u ON u.k=l.k AND u.row=l.at_row AND u.x1 BETWEEN 105 AND 210 AND u.text LIKE '-%' GROUP BY ALL),
 de AS (SELECT l.k, {'a':l.line_ord,'b':0,'c':0,'d':0} AS pl, date.m||'.'||date.d||CASE WHEN until IS NULL OR until::INT=date.d::INT THEN '' ELSE '-'||until END AS date_text, l.text AS performer, coalesce(here,gap,'') AS venue FROM lo l JOIN da USING (k, rn) LEFT JOIN un USING (k, rn)),
 ev AS (SELECT k, {'a':pl.a::DOUBLE,'b':pl.b::DOUBLE,'c':pl.c::DOUBLE,'d':pl.d::DOUBLE} AS pl, date_text, performer, venue FROM su UNION ALL SELECT k, {'a':pl.a::DOUBLE,'b':pl.b::DOUBLE,'c':pl.c::DOUBLE,'d':pl.d::DOUBLE}, date_text, performer, venue FROM de),
 fu AS (SELECT k, date_text, lower(replace(performer,' ','')) AS pk, min(pl) AS pl, arg_min({'p':performer,'v':venue}, {'b':venue='','at':pl}) AS x FROM ev GROUP BY ALL)"""

_ATTEMPTS = """x AS (SELECT user_id::VARCHAR AS note_id, hour(ts)::INT AS batch_index, event_id::INT AS ord, floor(coalesce(value,0))::INT%5 AS n, coalesce(event_type,'')<>'error' AND floor(coalesce(value,0))::INT%5>0 AS good FROM events),
 low AS (SELECT *, row_number() OVER (PARTITION BY note_id, batch_index ORDER BY ord) AS rk FROM x WHERE good AND n<3),
 agree AS (SELECT note_id, batch_index, max(ord) FILTER (WHERE rk=2) AS ord FROM low WHERE rk<=2 GROUP BY ALL HAVING count(*)=2 AND min(n)=max(n)),
 acc AS (SELECT b.note_id, b.batch_index, least(h.ord, agree.ord) AS upto FROM (SELECT DISTINCT note_id, batch_index FROM x) b LEFT JOIN (SELECT note_id, batch_index, min(ord) AS ord FROM x WHERE good AND n>=3 GROUP BY ALL) h USING (note_id, batch_index) LEFT JOIN agree USING (note_id, batch_index))"""

ORACLE_SQL = {
    "playlist_rollup": """WITH c AS (SELECT o_custkey AS pid, [epoch_us(o_orderdate), l_orderkey, l_linenumber, l_partkey] AS place, p_brand AS artist, trim(p_name) AS title FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey),
 t AS (SELECT pid, artist, title, count(*) AS n, min(place) AS place FROM c GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY pid, artist ORDER BY place) AS rk FROM t),
 g AS (SELECT pid, artist, sum(n)::BIGINT AS song_count, min(place) AS place, string_agg(title,'|' ORDER BY rk) FILTER (WHERE rk<=5) AS samples FROM k GROUP BY ALL)
SELECT pid AS playlist_id, row_number() OVER (PARTITION BY pid ORDER BY place)-1 AS artist_ord, artist AS name, song_count, samples FROM g""",
    "event_dates": f"""WITH {_EVENTS}, {_RANGE} SELECT event_index, date_text, m AS month, d AS day, s::INT AS first_day, t::INT AS last_day, coalesce(t-s+1,1)::INT AS days,
 m::VARCHAR||'月'||d::VARCHAR||'日'||CASE WHEN d2 IS NULL THEN '' ELSE '-'||d2::VARCHAR||'日' END AS shown, (m*100+d)::INT AS sort_key FROM o""",
    "overlapping_events": f"""WITH {_EVENTS}, {_RANGE}, v AS (SELECT job_id, event_index, date_text, s, unnest(CASE WHEN s<=31 THEN [0,365] ELSE [0] END) AS shift, s AS s0, t FROM o)
SELECT x.job_id, x.event_index, count(DISTINCT y.event_index) AS n FROM v x JOIN v y ON x.job_id=y.job_id AND ((x.s IS NULL OR y.s IS NULL) AND x.date_text=y.date_text OR x.s+x.shift<=y.t+y.shift AND y.s+y.shift<=x.t+x.shift) GROUP BY ALL""",
    "recognised": f"""WITH {_EVENTS} SELECT job_id AS note_id, event_index AS batch_index, date_text, {_CLEAN('performer')} AS performer, venue FROM e WHERE {_CLEAN('performer')}<>''""",
    "note_status": """WITH x AS (SELECT user_id, hour(ts) AS h, event_id, event_type, floor(coalesce(value,0))::INT%5 AS n, row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id) AS rk FROM events)
SELECT user_id::VARCHAR AS note_id, count(*) FILTER (WHERE NOT (coalesce(event_type,'')<>'error' AND n>0)) AS failed, count(*) AS total FROM x WHERE rk=1 GROUP BY user_id""",
    "note_urls": rf"""SELECT page_id, u AS note_url, sha256(u) AS note_key, lower({_URL},1))||'://'||lower({_URL},2))||regexp_replace({_URL},3),'/+$','') AS mark FROM (SELECT *, lower({_URL},1))||'://'||lower({_URL},2))||coalesce(nullif(regexp_replace({_URL},3),'/+$',''),''),'/') AS u FROM pages)""",
    "page_images": """WITH t AS (SELECT page_id, regexp_extract_all(replace(html,'<a href=','<img data-xhs-img src='),'(?i)<img\\b[^>]*data-xhs-img[^>]*>') AS tags FROM pages),
 u AS (SELECT page_id, list_filter(list_transform(tags, lambda t: regexp_extract(t,'\\bsrc="([^"]+)"',1)), lambda x: x<>'') AS raw FROM t),
 v AS (SELECT page_id, list_transform(raw, lambda x: CASE WHEN contains(x,'http://') THEN regexp_replace(replace(x,'&amp;','&'),'http://','https://') ELSE replace(x,'&amp;','&') END) AS a FROM u),
 w AS (SELECT page_id, list_slice(list_filter(a, lambda x, i: list_position(a,x)=i),1,20) AS a FROM v)
SELECT page_id, coalesce(len(a),0)::BIGINT AS n, coalesce(array_to_string(a,' '),'') AS urls FROM w""",
    "image_manifest": """SELECT doc_id, 'image.'||(['jpg','PNG','gif','webp'])[doc_id%4+1] AS filename FROM documents WHERE doc_id%4<>2 AND n_chars BETWEEN 1 AND 5000 AND doc_id%500 BETWEEN 1 AND 450 AND (doc_id%500)*400<=150000""",
    "known_pages": rf"""WITH p AS (SELECT page_id, lower({_URL},1))||'://'||lower({_URL},2))||coalesce(nullif(regexp_replace({_URL},3),'/+$',''),''),'/') AS u FROM pages) SELECT page_id, u IN (SELECT u FROM p WHERE page_id%3=0) AS known FROM p""",
    "resolved_tracks": """WITH t AS (SELECT o_custkey AS playlist_id, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
 own AS (SELECT playlist_id, l_partkey, arg_max('own '||l_orderkey::VARCHAR, {'a':l_orderkey,'b':l_linenumber}) AS name FROM t WHERE l_partkey%6=0 GROUP BY ALL)
SELECT t.playlist_id, l_orderkey, l_linenumber, CASE WHEN t.l_partkey%3<>0 THEN p_name ELSE own.name END AS name, CASE WHEN t.l_partkey%3<>0 THEN p_brand WHEN own.name IS NOT NULL THEN 'someone' ELSE '' END AS artists
FROM t LEFT JOIN part ON p_partkey=l_partkey LEFT JOIN own ON own.playlist_id=t.playlist_id AND own.l_partkey=t.l_partkey WHERE t.l_partkey<>0""",
    "rule_report": _RULES + " SELECT * FROM report",
    "anchored": _ANCHORED + " SELECT * FROM report",
    "report_sheet": _ANCHORED + ' SELECT job_id, index AS "序号", date_display AS "日期", artist_name AS "歌手", venue AS "演出场所", playlist_song_count AS "歌单出现次数", sample_songs AS "歌单代表歌曲", confidence AS "置信度" FROM report',
    "report_json": _ANCHORED + """, listed AS (SELECT job_id, list({'index':index,'date':date_display,'artist':artist_name,'venue':venue,'playlist_song_count':playlist_song_count,'sample_songs':[sample_songs],'confidence':confidence} ORDER BY index) AS matches, count(*) AS n FROM report GROUP BY ALL)
SELECT job_id, to_json({'matches':matches,'match_count':n,'playlist_artist_count':size,'event_count':size})::VARCHAR AS json FROM listed JOIN (SELECT job_id, count(*) AS size FROM e GROUP BY ALL) USING (job_id)""",
    "exact_anchors": f"WITH {_EVENTS}, {_ARTISTS}, {_ALIASES}, {_ANCHORS} SELECT job_id, event_index, artist_ord FROM anchor",
    "event_shortlists": _SHORTLISTS + " SELECT * FROM short",
    "packed_requests": _SHORTLISTS + """, rows AS (SELECT e.job_id, ((row_number() OVER (PARTITION BY e.job_id ORDER BY e.event_index)-1)//20)::INT AS batch_id, e.event_index, performer, date_text, candidates FROM e LEFT JOIN (SELECT job_id, event_index, list(name ORDER BY rank) AS candidates FROM short GROUP BY ALL) USING (job_id, event_index))
SELECT job_id, batch_id, count(*) AS n_events, to_json({'events':list({'event_index':event_index,'performer':performer,'date_text':date_text,'candidates':candidates} ORDER BY event_index)})::VARCHAR AS request FROM rows GROUP BY ALL""",
    "valid_suggestions": f"""WITH {_EVENTS}, {_ARTISTS}, {_SUGGESTED}, {_ALIASES}, {_TIERS}
SELECT s.job_id, 0::INT AS batch_id, s.event_index, s.artist_name, s.confidence, 'same words' AS reason, s.artist_name AS event_performer FROM s JOIN e USING (job_id, event_index) JOIN n x ON x.name=s.artist_name JOIN n y ON y.name=e.performer JOIN tier ON tier.job_id=s.job_id AND tier.event_index=s.event_index AND tier.artist_ord=s.event_index
WHERE s.artist_name<>'' AND x.key=y.key AND tier.r.t>=2""",
    "chinese_report": _chinese(_RULES + " SELECT * FROM report"),
    "chinese_anchored": _chinese(_ANCHORED + " SELECT * FROM report"),
    "reviewed_report": _REVIEWED + " SELECT * FROM report",
    "gated_suggestions": f"""{_SHORTLISTS}, {_SUGGESTED},
 b AS (SELECT job_id, event_index, performer, ((row_number() OVER (PARTITION BY job_id ORDER BY event_index)-1)//20)::INT AS batch_id FROM e),
 g AS (SELECT job_id, event_index, performer, batch_id, confidence, CASE WHEN event_index%7=0 THEN first.name WHEN event_index%3=2 THEN coalesce(fifth.name, artist_name) ELSE artist_name END AS artist_name
   FROM s JOIN b USING (job_id, event_index) JOIN (SELECT job_id, arg_min(name, artist_ord) AS name FROM a GROUP BY 1) first USING (job_id) LEFT JOIN (SELECT job_id, event_index, name FROM short WHERE rank=5) fifth USING (job_id, event_index)),
 ok AS (SELECT DISTINCT job_id, event_index, key FROM short JOIN n USING (name)), near AS (SELECT DISTINCT job_id, event_index, a.name FROM tier JOIN a USING (job_id, artist_ord) WHERE tier.r.t>=4)
SELECT g.job_id, batch_id, g.event_index, artist_name, confidence, 'same words' AS reason, performer AS event_performer FROM g JOIN n ON n.name=g.artist_name JOIN ok ON ok.job_id=g.job_id AND ok.event_index=g.event_index AND ok.key=n.key JOIN near ON near.job_id=g.job_id AND near.event_index=g.event_index AND near.name=g.artist_name
WHERE g.event_index%9<>0 AND g.event_index%10<>0 AND performer<>''""",
    "suggestion_answers": f"""WITH {_EVENTS}, x AS (SELECT e.job_id, (event_index//400)::INT AS batch_id, event_index, name, performer FROM e JOIN d ON d.doc_id=event_index WHERE name<>'')
SELECT job_id, batch_id, 0 AS response_ord, event_index, name AS artist_name, (['高','中','低'])[event_index%3+1] AS confidence, 'last' AS reason, performer AS event_performer FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.job_id=x.job_id AND y.batch_id=x.batch_id AND y.event_index%97=0)""",
    "review_answers": f"""WITH {_DOCS} SELECT doc_id, CASE WHEN k IN (0,1) THEN true WHEN k IN (2,5) THEN false END AS is_match, CASE WHEN k IN (0,1,2,5) THEN (['高','中','低'])[doc_id%3+1] END AS confidence, CASE WHEN k IN (0,1,2,5) THEN trim(name||' {{}}') END AS reason FROM (SELECT *, doc_id%6 AS k FROM d)""",
    "dictionary_aliases": """WITH p AS (SELECT p_partkey AS k, p_name||' '||p_partkey::VARCHAR AS name, CASE WHEN p_partkey%3=0 THEN ' (live)' ELSE '' END AS more FROM part),
 x AS (SELECT name||more AS performer, 0 AS kind, 0 AS m, name||more AS value, '图片演出名' AS reason FROM p UNION ALL SELECT name||more, 1, 0, name, '去括号名称' FROM p WHERE more<>'' UNION ALL SELECT name||more, 2, 0, 'live', '括号内名称' FROM p WHERE more<>''
   UNION ALL SELECT p.name||p.more, 3, o.k%8, o.name, '常见别名/译名' FROM p JOIN p o ON o.k//8=p.k//8 AND o.k<>p.k)
SELECT performer, (row_number() OVER (PARTITION BY performer ORDER BY kind, m)-1)::INT AS alias_ord, value, reason FROM x""",
    "playlist_ids": """SELECT page_id, CASE WHEN page_id%5<3 THEN page_id::VARCHAR WHEN page_id%5=3 THEN 'a+'||page_id::VARCHAR END AS playlist_id FROM pages""",
    "page_fingerprints": """SELECT part, fingerprint, left(sha256(fingerprint),16) AS source_key FROM (SELECT page_id%10 AS part, sha256(string_agg(sha256(coalesce(html,''))||chr(10),'' ORDER BY page_id)) AS fingerprint FROM pages GROUP BY 1)""",
    "stored_pages": rf"""WITH p AS (SELECT page_id, sha256(lower({_URL},1))||'://'||lower({_URL},2))||coalesce(nullif(regexp_replace({_URL},3),'/+$',''),''),'/')) AS fingerprint FROM pages),
 x AS (SELECT *, 'first' AS stage FROM p WHERE page_id%3=0 UNION ALL SELECT *, 'second' FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE page_id%3=0))
SELECT * FROM x WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE page_id%5=0) UNION ALL SELECT *, 'third' FROM p WHERE page_id%5=0""",
    "events_read_back": f"""WITH {_EVENTS} SELECT job_id AS note_id, event_index, date_text, performer, venue, '' AS image_name, '' AS source_note FROM e WHERE performer<>''""",
    "lines_read_back": f"WITH RECURSIVE {_LINES} SELECT k::VARCHAR AS note_id, count(*) AS n_lines, string_agg(pos::VARCHAR||':'||text,'|' ORDER BY pos) AS texts FROM (SELECT k, text, row_number() OVER (PARTITION BY k ORDER BY line_ord)-1 AS pos FROM sl) GROUP BY k",
    "deduplicated_events": f"""WITH x AS (SELECT note_id, doc_id*16777216+i-1 AS ord, '1.'||(doc_id%3)::VARCHAR AS date_text, w[i] AS performer, CASE WHEN doc_id%5=0 THEN 'hall' ELSE '' END AS venue FROM (SELECT doc_id, note_id, w, unnest(range(1,len(w)+1)) AS i FROM (SELECT doc_id, coalesce(source,'') AS note_id, regexp_extract_all(coalesce(text,''),'\\p{{L}}+') AS w FROM documents))),
 y AS (SELECT *, lower(performer) AS k FROM x)
SELECT note_id, min(ord) AS ord, date_text, arg_min(performer, {{'b':venue='','o':ord}}) AS performer, arg_min(venue, {{'b':venue='','o':ord}}) AS venue FROM y GROUP BY note_id, date_text, k""",
    "layout_rows": f"WITH RECURSIVE {_LINES} SELECT k::VARCHAR AS note_id, (row_number() OVER (PARTITION BY k ORDER BY pl)-1)::INT AS event_index, date_text, x.p AS performer, x.v AS venue, k::VARCHAR||'.jpg' AS image_name FROM fu",
    "accepted_batches": f"WITH {_ATTEMPTS} SELECT note_id, batch_index, upto FROM acc",
    "fused_events": f"""WITH {_ATTEMPTS}, one AS (SELECT note_id, batch_index, min(ord) FILTER (WHERE good) AS upto FROM x GROUP BY ALL), whole AS (SELECT note_id FROM one GROUP BY note_id HAVING bool_and(upto IS NOT NULL)),
 y AS (SELECT x.note_id, {{'b':x.batch_index,'o':x.ord,'i':i}} AS pl, i, CASE WHEN x.ord%3=0 THEN 'hall '||i::VARCHAR ELSE '' END AS venue FROM (SELECT *, unnest(range(1,n+1)) AS i FROM x WHERE good) x JOIN one USING (note_id, batch_index) JOIN whole ON whole.note_id=x.note_id WHERE x.ord<=upto)
SELECT note_id, '7.'||i::VARCHAR AS date_text, 'band '||i::VARCHAR AS performer, arg_min(venue, {{'e':venue='','at':pl}}) AS venue FROM y GROUP BY note_id, i""",
    "name_keys": f"""WITH {_DOCS}, w AS (SELECT unnest(regexp_split_to_array(coalesce(text,''),'[ \\n]')) AS name FROM documents UNION SELECT name FROM d),
 n AS (SELECT name, {_KEY('name')} AS key, regexp_matches(lower(strip_accents(name)),'[a-z]') AS latin, list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({_CLEAN('name')})),'[&+]',' and ','g'),'[^a-z0-9一-鿿]+'), lambda t: t NOT IN ('','and','the','live','concert','show','festival','上海','嘉宾','专场')) AS tokens FROM w)
SELECT name, key, translate(key,'1i0','llo') AS ocr, array_to_string(tokens,' ') AS tokens, CASE WHEN length(key)<=2 THEN least(length(key),1) ELSE len(list_distinct(list_transform(range(1,length(key)), lambda i: substr(key,i,2)))) END::BIGINT AS n_grams, latin FROM n""",
}
