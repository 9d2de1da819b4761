"""DuckDB expression text used by the oracle views."""

from plotlink import config as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def rep(x: str, pattern: str, to: str = "", glob: bool = True) -> str:
    tail = ", 'g'" if glob else ""
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}{tail})"


def norm(x: str) -> str:
    s = rep(f"lower(coalesce({x}, ''))", C.NAME_PUNCT)
    return f"trim({rep(rep(s, C.NAME_TITLES, ' '), '[^a-z]+', ' ')})"


def tidy(x: str) -> str:
    return f"trim({rep(rep(f"coalesce({x}, '')", r'\([^)]*\)', ' '), r'\s+', ' ')})"


COMMA = r"^([^,]+),\s*(.*)$"


def last(x: str) -> str:
    t = tidy(x)
    return (f"case when {has(t, COMMA)} then {rep(f'trim({rx(t, COMMA)})', C.NAME_SUFFIX_TAIL)} "
            f"else {rx(rep(t, C.NAME_SUFFIX_TAIL), r'(\S+)$')} end")


def first(x: str) -> str:
    t = tidy(x)
    return (f"case when {has(t, COMMA)} then trim({rx(t, COMMA, 2)}) "
            f"else trim({rep(rep(t, C.NAME_SUFFIX_TAIL), r'\S+$')}) end")


def soundex(n: str) -> str:
    """American sound code of a normalised name."""
    s = f"replace({n}, ' ', '')"
    codes = (f"translate(left({s}, 1) || regexp_replace(substr({s}, 2), '[hw]', '', 'g'), "
             "'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')")
    for d in "0123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return (f"case when {s} = '' then '' else left(upper(left({s}, 1)) || "
            f"replace(substr({codes}, 2), '0', '') || '000', 4) end")


def year(x: str) -> str:
    return f"coalesce(try_cast({rx(f"coalesce({x}, '')", C.YEAR)} as int), 0)"


def strip0(x: str) -> str:
    return rep(x, r"^0+(\d)", r"\1", glob=False)


def block(x: str) -> str:
    return strip0(f"upper(coalesce({x}, ''))")


def int_prefix(x: str) -> str:
    return f"try_cast({rx(f"coalesce({x}, '')", r'^\s*([+-]?\d+)')} as bigint)"


def lot_key(x: str) -> str:
    return f"coalesce(cast(nullif({int_prefix(x)}, 0) as varchar), {x}, '')"


def canonical_lot(x: str) -> str:
    return f"coalesce(cast({int_prefix(x)} as varchar), {x})"


NICK = "SELECT * FROM (VALUES " + ",".join(
    f"('{nick}','{canon}')" for nick, canon in C.NICKNAMES.items()) + ") t(nick, canon)"


def name_keys(src: str, name: str, alt: str | None, cols: str = "s.*") -> str:
    """SELECT adding last, first, nl, sx, nm, cf, fr, sk to a source view."""
    a = alt or "''"
    return f"""
      SELECT z.* EXCLUDE (fr0), fr0 AS fr, coalesce(n.canon, fr0) AS cf
      FROM (SELECT {cols}, {last(name)} AS last, {first(name)} AS first, {norm(last(name))} AS nl,
                   {soundex(norm(last(name)))} AS sx, {norm(a)} AS nm,
                   split_part({norm(first(name))}, ' ', 1) AS fr0,
                   {norm(name)} || case when coalesce({a}, '') = '' then '' else ' ' || {norm(a)} end AS sk
            FROM {src} s) z LEFT JOIN o_nick n ON z.fr0 = n.nick"""


def parse_plot(src: str, text: str) -> str:
    """SELECT adding section, sub, block, lot, grave (generic profile) to a source view."""
    s = f"trim({rep(rep(f"coalesce({text}, '')", '[().,]', ' '), r'\s+', ' ')})"
    lead = f"trim({rep(rep(rep('lead0', C.PLOT_RECORD_ID), C.PLOT_LONG_NUMBER), r'\s+', ' ')})"
    return f"""
      SELECT * EXCLUDE (s_, tok, sub0, blk0, lot0, grv0, sec0, lead0, lot1, grv1, lead1, sec1, dash, kind, d1, d2, d3, d4, half,
                        sec2, lot2, blk2, grv2)
      FROM (SELECT *, case when kind is not null then coalesce(nullif(sec2, ''), case when blk2 <> '' or lot2 <> '' or grv2 <> '' then '*' end) end AS section,
        case when section is not null then sub0 end AS sub, case when section is not null then blk2 end AS block,
        case when section is not null then {canonical_lot('lot2')} end AS lot, case when section is not null then grv2 end AS grave
      FROM (SELECT *,
        case when kind = 'dash' then d1 when kind = 'name' then s_ else sec1 end AS sec2,
        case when kind = 'dash' and half then d2 when kind = 'dash' then d3 when kind = 'lot_letter' then {rx('s_', C.PLOT_LOT_LETTER)}
             when kind = 'lot' then s_ else lot1 end AS lot2,
        case when kind = 'dash' and half then '' when kind = 'dash' then d2 when kind = 'block' then upper(s_) else blk0 end AS blk2,
        case when kind = 'dash' then d4 when kind = 'lot_letter' then upper({rx('s_', C.PLOT_LOT_LETTER, 2)}) else grv1 end AS grv2
      FROM (SELECT *, d3 = '' or {has('d3', C.PLOT_HALF_LOT)} AS half,
        case when s_ = '' or {has('s_', C.PLOT_JUNK)} then null
             when sec1 <> '' or blk0 <> '' or lot1 <> '' or grv1 <> '' then 'tokens'
             when len(dash) >= 4 then 'dash'
             when {has('s_', C.PLOT_LOT_LETTER)} then 'lot_letter'
             when {has('s_', '^[A-Za-z]{1,2}$')} then 'block'
             when {has('s_', r'^\d{1,4}$')} then 'lot'
             when {has('s_', C.PLOT_BARE_NAME)} and not {has('s_', C.PLOT_BARE_NAME_NOT)} then 'name' end AS kind
      FROM (SELECT *, {lead} AS lead1,
        case when grv0 = '' then tok else grv0 end AS grv1,
        case when lot0 = '' and grv0 <> '' then tok else lot0 end AS lot1,
        case when sec0 <> '' and not {has('sec0', C.PLOT_SECTION_NOT)} then 'Section ' || upper(sec0)
             when length(lead1) > 1 and not {has('lead1', r'^\d+$')} then lead1 else '' end AS sec1,
        regexp_split_to_array(s_, '\\s*-\\s*') AS dash,
        coalesce(dash[2], '') AS d1, {block('dash[3]')} AS d2, {strip0("coalesce(dash[4], '')")} AS d3, coalesce(dash[5], '') AS d4
      FROM (SELECT *, {rx('s_', C.PLOT_SUB)} AS sub0, {block(rx('s_', C.PLOT_BLOCK))} AS blk0, {rx('s_', C.PLOT_LOT)} AS lot0,
        {rx('s_', C.PLOT_GRAVE)} AS grv0, {rx('s_', C.PLOT_TOKEN)} AS tok, {rx('s_', C.PLOT_SECTION)} AS sec0, {rx('s_', C.PLOT_LEAD)} AS lead0
      FROM (SELECT *, {s} AS s_ FROM {src}))))))"""


DEG = "(pi() / 180 * 6371000.0::double)"


def hav(a, b, c, d, r="6371000.0::double"):
    h = (f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
         f"pow(sin(radians({d} - {b}) / 2), 2))")
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(1 - {h})))"


def east(lng, clat, clng):
    return f"(({lng} - {clng}) * ({DEG} * cos(radians({clat}))))"


def north(lat, clat):
    return f"(({lat} - {clat}) * {DEG})"


def to_lat(n, clat):
    return f"({clat} + {n} / {DEG})"


def to_lng(e, clat, clng):
    return f"({clng} + {e} / ({DEG} * cos(radians({clat}))))"
