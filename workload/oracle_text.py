"""SQL with the same results as the queries, written against the driver tables.

Each statement states the rule directly (as-of joins, correlated lookups, source words
of the round trip) rather than following the Spark plan.
"""

from __future__ import annotations

from workload import oracle_names

ENABLE, DISABLE = 6291585, 6291456

_K = ",".join(f"({k})" for k in range(12))
_BITS = ",".join(f"({b})" for b in range(24))


def _lv(k: int) -> str:
    return f"cast(((event_id * {2 * k + 3} + user_id * {k + 1}) >> {k % 5}) & 1 as int)"


FRAMES = """frames as (
  select c_custkey * 1000 as base,
         (c_custkey % 256) * 65536 + (c_nationkey * 251 + c_custkey * 7) % 65536 as word
  from customer)"""
LEVELS = f"""levels as (
  select cast(k as int) as channel, event_id as position,
         cast(((event_id * (2 * k + 3) + user_id * (k + 1)) >> cast(k % 5 as int)) & 1 as int) as v
  from events cross join (values {_K}) as c(k))"""
# archives of 4,096 samples, at 100 and 50 MHz in turn
RUN_NAME = "'c' || (position // 4096 % 3) || '/run' || position // 4096"
RUN_STEP = "case position // 4096 % 2 when 1 then 20 else 10 end"
ARCHIVED = LEVELS + f""", archived as (
  select {RUN_NAME} as capture_id, {RUN_STEP} as step, channel, position % 4096 as position, v from levels)"""
RUNS = LEVELS + """, flagged as (
  select *, lag(v) over (partition by channel order by position) as p from levels),
runs as (select channel, position * 10 as start_time, v from flagged where p is null or p <> v)"""
WIDE = "wide as (select event_id as position, " + ", ".join(f"{_lv(k)} as d{k}" for k in range(12)) + " from events)"
STROBE = WIDE + ", st as (select *, coalesce(lag(d10) over (order by position), 0) as prev from wide)"
BYTE = " + ".join(f"(d{i} << {i})" for i in range(8))
COMMANDS = f"""commands as (
  select event_id as seq, event_id * 1000 as time_ns,
    cast(case when event_type = 'signup' then {ENABLE}
              when event_type = 'error' then {DISABLE}
              else (case when event_type = 'click' then 8388608 else 0 end)
                   + (user_id % 128) * 65536 + event_id % 65536 end as bigint) as mosi
  from events)"""
BLOCKY = f"""commands as (
  select event_id as seq, event_id * 1000 as time_ns,
    cast(case when event_type = 'signup' and (event_id // 64) % 2 = 0 then {ENABLE}
              when event_type = 'error' and (event_id // 64) % 2 = 1 then {DISABLE} else 0 end as bigint) as mosi
  from events)"""
_CONTROL = f""", two as (
  select time_ns as t, case when mosi = {ENABLE} then 1 else 0 end as s from commands where mosi in ({ENABLE}, {DISABLE})),
chg as (select t, s, lag(s, 1, 0) over (order by t) as p from two),
control as (select 0 as t, 0 as s where exists (select 1 from commands) union all select t, s from chg where s <> p)"""
CONTROL = COMMANDS + _CONTROL
BLOCKY_CONTROL = BLOCKY + _CONTROL
WORDS = STROBE + f""", words as (
  select position * 1000 as t, {BYTE} as value from st where d10 <> prev)"""


def sessions(words: str = WORDS, control: str = BLOCKY_CONTROL) -> str:
    return (
        words
        + ", "
        + control
        + """, owned as (
  select w.t, w.value, c.t as enabled_at
  from words w asof join (select t, max(s) as s from control group by t) c on w.t >= c.t where c.s = 1),
sw as (
  select t, value, enabled_at, dense_rank() over (order by enabled_at) as file_num,
         row_number() over (partition by enabled_at order by t) - 1 as byte_index from owned)"""
    )


def lines(words: str = WORDS, control: str = BLOCKY_CONTROL) -> str:
    return (
        sessions(words, control)
        + """, lc as (
  select min(event_id) * 1000 as t, cast((event_id // 5) % 2 as int) as v from events group by event_id // 5),
le as (select t, v, lag(v, 1, 0) over (order by t) as p from lc),
edges as (select t, v from le where v <> p),
span as (select file_num, min(t) as a, max(t) as b from sw group by file_num),
inside as (select s.file_num, e.t, e.v from edges e join span s on e.t > s.a and e.t <= s.b),
se as (
  select i.file_num, i.t as edge_t, i.v as rising, w.byte_index, w.t as clock_t
  from inside i asof join sw w on i.file_num = w.file_num and i.t <= w.t),
nx as (
  select *, lead(rising) over w as nr, lead(edge_t) over w as nt, lead(byte_index) over w as nb, lead(clock_t) over w as nc
  from se window w as (partition by file_num order by edge_t)),
records as (
  select file_num, byte_index as rising_byte_index, edge_t as rising_timestamp,
    case when nr = 0 then nb else 0 end as falling_byte_index, case when nr = 0 then nt else 0 end as falling_timestamp,
    byte_index as first_clock_rising_byte_index, clock_t as first_clock_rising_timestamp,
    case when nr = 0 then nb else 0 end as first_clock_falling_byte_index,
    case when nr = 0 then nc else 0 end as first_clock_falling_timestamp
  from nx where rising = 1),
steps as (
  select file_num, case when n > f then n - f when n is not null then 0 end as s from (
    select file_num, falling_byte_index as f,
      lead(falling_byte_index) over (partition by file_num order by rising_timestamp) as n from records)),
widths as (
  select file_num, list_sort(list(s))[count(*) // 2 + 1] as width from steps
  where s is not null group by file_num)"""
    )


LINES = lines()
# the frames of a capture in which every 100 events carry one, stamped with their first clock edge
FRAMED_CONTROL = f"""commands as (
  select (event_id + 12) * 1000 as time_ns,
    case when event_id // 100 % 4 = 1 then {ENABLE} when event_id // 100 % 4 = 3 then {DISABLE} else 0 end as mosi
  from events where event_id % 100 = 0 and event_id + 70 <= (select max(event_id) from events))""" + _CONTROL
GATED_WORDS = STROBE + """, words as (
  select position * 1000 as t, d11 + (d9 << 1) + (d4 << 2) as value from st where d10 = 1 and prev = 0 and d8 = 1)"""
WRITES = COMMANDS + f""", writes as (
  select seq, time_ns, cast((mosi >> 16) & 127 as int) as register, cast(mosi & 65535 as int) as value
  from commands where mosi not in ({ENABLE}, {DISABLE}) and (mosi >> 23) & 1 = 0),
enables as (
  select seq, time_ns, row_number() over (order by seq) as enable_num from commands where mosi = {ENABLE}),
snapshots as (
  select e.enable_num, e.time_ns, w.register, arg_max(w.value, w.seq) as value
  from enables e join writes w on w.seq < e.seq group by all)"""
DURATIONS = COMMANDS + f""", two as (
  select seq, time_ns, mosi, sum(case when mosi = {ENABLE} then 1 else 0 end) over (order by seq) as enable_num,
    lag(mosi) over (order by seq) as pm, lag(time_ns) over (order by seq) as pt
  from commands where mosi in ({ENABLE}, {DISABLE})),
durations as (
  select cast(enable_num as bigint) as enable_num, time_ns - pt as duration_ns from two
  where mosi = {DISABLE} and pm = {ENABLE}),
longest as (select enable_num, duration_ns from durations order by duration_ns desc, enable_num desc limit 1)"""
PIXELS = """flat as (
  select vec_id as row, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from embeddings),
px as (
  select row, i // 3 as col,
    coalesce(max(case when i % 3 = 0 then v end), 0) as g, coalesce(max(case when i % 3 = 1 then v end), 0) as b,
    coalesce(max(case when i % 3 = 2 then v end), 0) as r
  from (select row, i, cast(floor((cast(x as double) + 1) * 20000) as int) as v from flat) group by row, i // 3)"""


def _mul(c: str, divisor: int) -> str:
    """Product with the single-precision reciprocal, as the display does."""
    return (
        f"cast(trunc(greatest(cast(0 as float), least(cast(255 as float), "
        f"cast({c} as float) * cast(1.0 / {divisor} as float)))) as int)"
    )


SCALED = PIXELS + f""", sc as (
  select row, col, {_mul('g', 96)} as g, {_mul('b', 96)} as b, {_mul('r', 96)} as r from px)"""
MEANS = PIXELS + """, means as (
  select row, avg(g) as g, avg(b) as b, avg(r) as r from px
  where col between 1 and 20 group by row),
deriv as (
  select row, lead(g) over (order by row) - g as g, lead(b) over (order by row) - b as b, lead(r) over (order by row) - r as r
  from means qualify lead(row) over (order by row) is not null)"""


def profile(plane: str, d: int = 80) -> str:
    return MEANS + f""", deltas as (select unnest(range(-{d}, {d} + 1)) as delta),
pairs as (
  select delta, x.row, x.g as a, y.{plane} as b from deltas, deriv x join deriv y on y.row = x.row + delta),
prof as (
  select delta, count(*) as n,
    case when count(*) * sqrt(var_pop(a) * var_pop(b)) > 1e-12 then covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) else 0 end as corr
  from pairs group by delta having count(*) >= 10)"""


def _shift(source: str, blue: str, red: str) -> str:
    return f"""h as (select max(row) as m from px),
keyed as materialized (
  select row, col, g, greatest(0, least(m, row {blue})) as br, greatest(0, least(m, row {red})) as rr from {source}, h),
planes as materialized (select row as prow, col as pcol, b, r from {source}),
shifted as (
  select k.row, k.col, k.g, x.b, y.r from keyed k join planes x on x.prow = br and x.pcol = col
  join planes y on y.prow = rr and y.pcol = col)"""


def _describe(source: str) -> str:
    def values(d: dict) -> str:
        return ",".join(f"({k}, '{v}')" for k, v in d.items())

    return f"""{source}, regs as (
  select * from (values {values(oracle_names.REGISTERS)}) t(reg, name)),
specials as (select * from (values {values(oracle_names.COMMANDS)}) t(cmd, special)),
seqs as (select * from (values {values(oracle_names.SEQUENCER)}) t(sv, sname)),
f as (
  select seq, mosi, (mosi >> 23) & 1 as rd, (mosi >> 16) & 127 as reg, mosi & 65535 as value from src),
described as (
  select f.seq, f.mosi, coalesce(name, printf('REG_%02X', f.reg)) as register_name, special,
    case when f.mosi is null then null
      when special is not null then special
      when f.reg in (120, 121, 122) then printf('%s %s gain=0x%02X offset=0x%02X', case rd when 1 then 'read' else 'write' end,
        case f.reg when 120 then 'RED' when 121 then 'GREEN' else 'BLUE' end, value >> 8, value & 255)
      when f.reg = 98 then case rd when 1 then 'READ' else 'WRITE' end || ' RGB_SEQUENCER ' || coalesce(sname, printf('cmd=0x%04X', value))
      when f.reg <= 63 and rd = 0 and value & 49152 <> 0 and value <> 65535 then printf('WRITE %s config=0x%04X', coalesce(name, printf('REG_%02X', f.reg)), value)
      when f.reg <= 63 and value = 65535 then case rd when 1 then 'READ' else 'WRITE' end || ' ' || coalesce(name, printf('REG_%02X', f.reg)) || ' verify=0xFFFF'
      when f.reg <= 63 and value = 0 and rd = 0 then 'WRITE ' || coalesce(name, printf('REG_%02X', f.reg)) || ' = 0x0000 (clear)'
      else printf('%s %s = 0x%04X', case rd when 1 then 'READ' else 'WRITE' end, coalesce(name, printf('REG_%02X', f.reg)), value) end as description
  from f left join regs on regs.reg = f.reg left join specials on cmd = f.mosi left join seqs on sv = f.value)"""


DESCRIBED = _describe("with " + COMMANDS + ", src as (select seq, mosi from commands)")
NOISE_CLOCK = RUNS + """, cs as (
  select start_time as a, v, lead(start_time) over (order by start_time) as b from runs where channel = 8),
win as (select a, b, coalesce(lag(b) over (order by a), 0) as pb from cs where v = {active} and b is not null),
clk as (select start_time as s, v, lead(start_time) over (order by start_time) as e from runs where channel = 7),
k as (select a, b, s as t, clk.v from clk join win on s < b and (e > a or e is null) and s >= pb),
kp as (select *, lag(v, 1, 0) over (order by t) as previous from k)"""


def _noise_words(active: int, rising: bool, bits: int = 1) -> str:
    edge = "v = 1 and previous = 0" if rising else "v = 0 and previous = 1"
    return "with " + NOISE_CLOCK.replace("{active}", str(active)) + f""", s as (
  select a, t, greatest(t - 1, 0) as at, row_number() over (partition by a order by t) - 1 as i from kp where {edge}),
m as (select start_time, v from runs where channel = 6), n as (select start_time, v from runs where channel = 5)
select s.a as window_id, s.i // {bits} as word_no,
  cast(sum(m.v << cast({bits} - 1 - s.i % {bits} as int)) as bigint) as mosi,
  cast(sum(n.v << cast({bits} - 1 - s.i % {bits} as int)) as bigint) as miso, min(s.t) as t_ns
from s asof join m on s.at >= m.start_time asof join n on s.at >= n.start_time
group by s.a, s.i // {bits} having count(*) = {bits}"""


def _trigger(where: str) -> str:
    return f"with {STROBE} select position, position * 10 as t_ns from st where {where}"


ORACLES: dict[str, str] = {
    "cs_windows": f"with {FRAMES} select base + 100 as a, base + 700 as b, case when base = 0 then 0 else base - 300 end as pb from frames",
    "cs_active": f"""with {FRAMES}, r as (
  select 0 as t, 1 as v union all select base + 100, 0 from frames union all select base + 700, 1 from frames)
select t as start_time, 1 - v as low, v as high, 1 as none from r""",
    "spi_word": f"with {FRAMES} select base + 100 as window_id, 0 as word_no, word as mosi, 0 as miso, base + 120 as t_ns, (base + 120) / 1000 as timestamp_us from frames",
    "spi_word_blocks": """select o_orderkey * 1000 + 100 as window_id, 0 as word_no,
  (o_orderkey % 256) * 65536 + (o_custkey * 251 + o_orderkey * 7) % 65536 as mosi, 0 as miso, o_orderkey * 1000 + 120 as t_ns from orders""",
    "spi_word_bytes": f"""with {FRAMES} select base + 100 as window_id, n as word_no, (word >> cast(16 - 8 * n as int)) & 255 as mosi, base + 120 + 160 * n as t_ns
from frames cross join (values (0),(1),(2)) t(n)""",
    "spi_word_noise_rising": _noise_words(1, True),
    "spi_word_noise_falling": _noise_words(0, False),
    "spi_word_noise_pairs": _noise_words(1, True, 2),
    "first_words_each": f"""with {WIDE}, st as (
  select *, coalesce(lag(d10) over (partition by position // 4096 order by position), 0) as prev from wide),
w as (select {RUN_NAME} as capture_id, position % 4096 * {RUN_STEP} as t_ns, {BYTE} as value from st where d10 <> prev)
select capture_id, t_ns, value from w qualify row_number() over (partition by capture_id order by t_ns) <= 10""",
    "spi_sampling_edge": f"with {FRAMES} select base + 100 as a, base + 130 + 20 * b as t from frames cross join (values {_BITS}) t(b)",
    "bit_index": f"with {FRAMES} select base + 100 as a, base + 120 + 20 * b as t, b as bit_no from frames cross join (values {_BITS}) t(b)",
    "cs_window_clock": "with " + NOISE_CLOCK.replace("{active}", "0") + " select a, b, t, v as value from kp",
    "clock_prev_carry": "with " + NOISE_CLOCK.replace("{active}", "0") + " select a, t, v as value, previous from kp",
    "asof_level": f"""with {RUNS}, p as (select greatest(start_time - 1, 0) as t from runs where channel = 7)
select p.t, m.v as level from p asof join (select * from runs where channel = 6) m on p.t >= m.start_time""",
    "spi_csv_sink": f"""with {FRAMES} select row_number() over (order by base) as "Id", (base + 120) || '.00' as "Time[ns]",
  printf('%06X', word) as "1:SPI: MOSI data" from frames""",
    "spi_show": f"""with {FRAMES} select base + 120 as t_ns,
  printf('MOSI=0x%06X MISO=0x%06X at t=%.6fs (pos=%d)', word, 0, (base + 120) / 1000 / 1e6, base + 120) as text
from frames order by base limit 100""",
    "limit_n": f"with {FRAMES} select base + 120 as t_ns, word as mosi from frames order by base limit 50",
    "edge_runs": f"with {RUNS} select channel, start_time, v as value from runs",
    "run_bounds": f"with {RUNS} select channel, start_time, lead(start_time) over (partition by channel order by start_time) as next_start, v as value from runs",
    "edge_detect": f"""with {RUNS}, e as (select *, lag(v, 1, 0) over (partition by channel order by start_time) as b from runs)
select channel, start_time, case when b = 0 and v = 1 then 1 else 0 end as rising, case when b = 1 and v = 0 then 1 else 0 end as falling from e""",
    "bit_unpack": f"with {LEVELS} select channel, position, v as value from levels",
    "packed_blocks": f"""with {LEVELS}, packed as (
  select channel, position // 8 as n, sum(v << cast(position % 8 as int)) as x, max(position) as m from levels group by all)
select channel, n // 128 as block_num, string_agg(printf('%02X', cast(x as int)), '' order by n) as data_hex,
  n // 128 * 1024 as start_position, max(m) + 1 - n // 128 * 1024 as num_samples, 10 as timestamp_step from packed group by channel, n // 128""",
    "archive_blocks": f"""with {ARCHIVED}, packed as (
  select capture_id, step, channel, position // 8 as n, sum(v << cast(position % 8 as int)) as x, max(position) as m
  from archived group by all),
ends as (select capture_id, channel, position // 1024 as block_num, arg_min(v, position) as first, arg_max(v, position) as last
  from archived group by capture_id, channel, position // 1024),
whole as (select capture_id, step as timestamp_step, channel, n // 128 as block_num,
  string_agg(printf('%02X', cast(x as int)), '' order by n) as data_hex,
  n // 128 * 1024 as start_position, max(m) + 1 - n // 128 * 1024 as num_samples
  from packed group by capture_id, step, channel, n // 128)
select * from whole join ends using (capture_id, channel, block_num)""",
    "capture_header": f"""with {ARCHIVED}, one as (
  select capture_id, step, count(*) as n from archived where channel = 0 group by capture_id, step)
select capture_id, 12 as total_probes, case step when 10 then '100 MHz' else '50 MHz' end as samplerate, n as total_samples,
  (n + 1023) // 1024 as total_blocks, least(1024, (n + 7) // 8 * 8) as samples_per_block, 'line 3' as probe3,
  round(n * case step when 10 then 1e-8 else 2e-8 end, 9) as duration_s from one""",
    "archive_aligned": f"""with {WIDE}, st as (
  select *, coalesce(lag(d10) over (partition by position // 4096 order by position), 0) as prev from wide)
select {RUN_NAME} as capture_id, position % 4096 as position, {BYTE} as value, position % 4096 * {RUN_STEP} as t_ns,
  position % 4096 * {RUN_STEP} / 1000 as timestamp_us from st where d10 <> prev and d8 = 1""",
    "command_log_scan": f"""with {COMMANDS} select seq // 1000 as log, row_number() over (partition by seq // 1000 order by seq) as place,
  cast(time_ns as double) as time_ns, mosi from commands""",
    "annotated_csv_sink": f"""{DESCRIBED} select case when seq % 3 = 0 then 'x' else cast(seq % 7 as varchar) end as id,
  printf('%d.00', time_ns) as time_text, printf('%06X', commands.mosi) as mosi_text, 'note ' || seq as note, description
  from described join commands using (seq)""",
    "capture_body_scan": f"""with {sessions()} select file_num, byte_index // 48 as chunk_no,
  string_agg(printf('%02X', value & 255), '' order by byte_index) as data_hex from sw group by file_num, byte_index // 48""",
    "block_bounds": f"""with {LEVELS} select channel, position // 1024 as block_num, min(position) as start_position, max(position) + 1 as end_position,
  min(position) * 10 as start_ns, (max(position) + 1) * 10 as end_ns from levels group by channel, position // 1024""",
    "bounded_scan": f"with {LEVELS} select channel, position, v as value from levels where position < 1500",
    "channel_projection": f"with {RUNS} select channel, start_time, v as value from runs where channel in (2, 5, 11)",
    "run_counter": f"with {RUNS} select channel, least(count(*), 3000) as n_runs from runs group by channel",
    "probe_bit": f"""with {LEVELS}, k as (select cast(user_id % 14 as int) as channel, event_id * 3 - user_id % 5 as position from events),
n as (select count(*) as n from events)
select k.channel, k.position,
  case when k.channel >= 12 then 'invalid_probe' when k.position < 0 or k.position >= n then 'out_of_bounds' else 'ok' end as status,
  case when k.channel < 12 then l.v end as bit
from k cross join n left join levels l on l.channel = k.channel and l.position = k.position""",
    "block_align": f"""with {LEVELS}, packed as (
  select channel, position // 8 as n, sum(v << cast(position % 8 as int)) as x, max(position) as m from levels where channel in (0, 3, 9) group by all),
h as (select n // 128 as block_num, channel, string_agg(printf('%02X', cast(x as int)), '' order by n) as d, max(m) as m from packed group by all)
select block_num, block_num * 1024 as start_position, max(m) + 1 - block_num * 1024 as num_samples,
  max(case when channel = 0 then d end) as c0, max(case when channel = 3 then d end) as c3, max(case when channel = 9 then d end) as c9
from h group by block_num""",
    "strobe_trigger_rising": _trigger("d10 = 1 and prev = 0"),
    "strobe_trigger_falling": _trigger("d10 = 0 and prev = 1"),
    "strobe_trigger_any": _trigger("d10 <> prev"),
    "strobe_trigger_high": _trigger("d10 = 1"),
    "strobe_trigger_low": _trigger("d10 = 0"),
    "cs_inactive_gate": f"with {STROBE} select position from st where d10 = 1 and prev = 0 and d8 = 1",
    "parallel_word": f"with {STROBE} select position, {BYTE} as value, position * 10 as t_ns, position * 10 / 1000 as timestamp_us from st where d10 <> prev and d8 = 1",
    "parallel_word_level": f"with {STROBE} select position, d11 + (d9 << 1) + (d4 << 2) as value from st where d10 = 1 and d8 = 0",
    "command_match": f"with {COMMANDS} select seq, case mosi when {ENABLE} then 1 when {DISABLE} then 0 end as state from commands",
    "control_state": f"with {CONTROL} select t as t_ns, s as state from control",
    "initial_state_union": f"with {CONTROL} select s as state, t as t_ns from control",
    "state_monitor": f"with {CONTROL} select t as t_ns, case s when 1 then 'ENABLED' else 'DISABLED' end as report from control",
    "command_monitor": f"""with {COMMANDS} select time_ns as t_ns, mosi, printf('SPI Command: 0x%06X at t=%.6fs', mosi, time_ns / 1e9) as report
from commands where mosi in ({ENABLE}, {DISABLE})""",
    "enable_asof": f"""with {STROBE}, {CONTROL}, w as (select position * 1000 as t from st where d10 <> prev)
select w.t as t_ns, coalesce(c.s, 0) as enabled from w asof left join (select t, max(s) as s from control group by t) c on w.t >= c.t""",
    "enable_gate": f"""with {WORDS}, {CONTROL} select w.t as t_ns, value from words w
asof join (select t, max(s) as s from control group by t) c on w.t >= c.t where c.s = 1""",
    "session_asof": f"with {sessions(control=CONTROL)} select t as t_ns, enabled_at from owned",
    "session_id": f"with {sessions()} select t as t_ns, value, file_num from sw",
    "byte_index": f"with {sessions()} select file_num, byte_index, t as t_ns from sw",
    "session_summary": f"""with {sessions()} select file_num, count(*) as words, min(t) / 1000 as start_time_us, max(t) / 1000 as end_time_us,
  max(t) / 1000 - min(t) / 1000 as duration_us, min(t) as start_pos, max(t) as end_pos from sw group by file_num""",
    "capture_index": f"""with {LINES} select sw.file_num, printf('capture_%04d.bin', sw.file_num) as filename, count(*) as bytes,
  coalesce(max(width), 0) as width, min(t) / 1000 as start_time_us, max(t) / 1000 as end_time_us,
  max(t) / 1000 - min(t) / 1000 as duration_us, min(t) as start_pos, max(t) as end_pos
from sw left join widths using (file_num) group by sw.file_num""",
    "controlled_capture_blocks": f"""with {lines(control=FRAMED_CONTROL)} select sw.file_num, printf('capture_%04d.bin', sw.file_num) as filename, count(*) as bytes,
  coalesce(max(width), 0) as width, min(t) / 1000 as start_time_us, max(t) / 1000 as end_time_us,
  max(t) / 1000 - min(t) / 1000 as duration_us, min(t) as start_pos, max(t) as end_pos
from sw left join widths using (file_num) group by sw.file_num""",
    "capture_body_sink": f"""with {sessions()} select file_num, byte_index // 64 as chunk_no,
  string_agg(printf('%02X', value & 255), '' order by byte_index) as data_hex from sw group by file_num, byte_index // 64""",
    "line_edge_to_word": f"with {LINES} select file_num, edge_t, byte_index, clock_t, rising from se",
    "line_records": f"with {LINES} select * from records",
    "line_width": f"with {LINES} select file_num, width from widths",
    "line_offsets": f"""with {LINES}, o as (
  select file_num, falling_byte_index as f, row_number() over (partition by file_num order by rising_timestamp) as n,
    count(*) over (partition by file_num) as m from records)
select file_num, n - 1 as row, greatest(f + 4, 0) as line_start from o where n < m""",
    "controlled_capture": f"""with {lines(GATED_WORDS)} select sw.file_num, count(*) as bytes, coalesce(max(width), 0) as width,
  min(t) as start_pos, max(t) as end_pos from sw left join widths using (file_num) group by sw.file_num""",
    "decode_command": f"with {COMMANDS} select seq, cast((mosi >> 23) & 1 as int) as is_read, cast((mosi >> 16) & 127 as int) as register, cast(mosi & 65535 as int) as value from commands",
    "describe_command": f"{DESCRIBED} select seq, description from described",
    "describe_command_dense": _describe(
        """with src as (select event_id as seq, (event_id % 256) * 65536 + case event_id % 7 when 0 then 65535 when 1 then 0
  when 2 then 526 when 3 then 49152 + event_id % 255 when 4 then 129 when 5 then 256 else event_id % 65536 end as mosi from events)"""
    )
    + " select seq, mosi, description from described",
    "decode_gain": f"""with {COMMANDS}, g as (select seq, ((mosi >> 16) & 127) % 4 as c, mosi & 65535 as v, (mosi >> 23) & 1 as rd from commands)
select seq, case when c < 3 then printf('%s %s gain=0x%02X offset=0x%02X', case rd when 1 then 'read' else 'write' end,
  case c when 0 then 'RED' when 1 then 'GREEN' else 'BLUE' end, v >> 8, v & 255) end as gain_text from g""",
    "register_names": f"{DESCRIBED} select seq, register_name from described",
    "special_commands": f"{DESCRIBED} select seq, special from described",
    "bad_command_text": f"{DESCRIBED} select seq, case seq % 11 when 0 then '???' when 1 then '' else description end as description from described",
    "register_write_filter": f"with {WRITES} select seq, register, value from writes",
    "register_state": f"with {WRITES} select register, arg_max(value, seq) as value from writes group by register",
    "enable_number": f"with {WRITES} select seq, enable_num from enables",
    "register_snapshot": f"with {WRITES} select enable_num, time_ns, register, value from snapshots",
    "snapshot_size": f"""with {WRITES} select e.enable_num, count(distinct w.register) as registers
from enables e left join writes w on w.seq < e.seq group by e.enable_num""",
    "capture_durations": f"with {DURATIONS} select enable_num, duration_ns from durations",
    "longest_capture": f"with {DURATIONS} select enable_num, duration_ns from longest",
    "snapshot_pick": f"with {WRITES}, {DURATIONS.split(', two as', 1)[1].join(['two as', ''])} select s.enable_num, register, value from snapshots s join longest using (enable_num)",
    "ordered_registers": f"with {WRITES} select register, value from snapshots where enable_num = 3",
    "register_csv_sink": f"with {WRITES} select printf('0x%02X', register) as register, printf('0x%04X', value) as value_hex, value as value_dec from snapshots where enable_num = 5",
    "register_dump": f"with {WRITES}, {DURATIONS.split(', two as', 1)[1].join(['two as', ''])} select printf('0x%02X', register) as register, printf('0x%04X', value) as value_hex, value as value_dec from snapshots s join longest using (enable_num)",
    "pixel_u16": f"with {PIXELS} select row, col, g, b, r from px",
    "luma": f"with {SCALED} select row, col, cast(trunc(0.299::double * r + 0.587::double * g + 0.114::double * b) as int) as lum from sc",
    "gain_gamma": f"with {PIXELS} select row, col, {_mul('g', 64)} as g, {_mul('b', 64)} as b, {_mul('r', 64)} as r from px",
    "gain_gamma_sqrt": f"with {PIXELS} select row, col, "
    + ", ".join(
        f"cast(trunc(cast(sqrt(cast(least(cast(255 as float), cast({c} as float) * cast(1.0 / 128 as float)) / cast(255 as float) as float)) as float) * cast(255 as float)) as int) as {c}"
        for c in "gbr"
    )
    + " from px",
    "pack_rgb": f"with {SCALED} select row, col, (r << 16) + (g << 8) + b as rgb from sc",
    "unpack_rgb": f"""with {PIXELS}, u as (select row, col, (g * 251 + b * 7) % 16777216 as x from px)
select row, col, x >> 16 as r, (x >> 8) & 255 as g, x & 255 as b from u""",
    "channel_toggle": f"with {PIXELS} select row, col, 0 as g, b, r from px",
    "row_shift_compose": f"""with {PIXELS}, {_shift('px', '- 3', '+ 5')} select row, col, g, b, r from shifted""",
    "frame_decode": f"""with {SCALED}, {_shift('sc', '+ 2', '+ 4')} select row, col, (r << 16) + (g << 8) + b as rgb from shifted""",
    "frame_decode_gray": f"""with {SCALED}, l as (select row, col, cast(trunc(0.299::double * r + 0.587::double * g + 0.114::double * b) as int) as v from sc)
select row, col, v * 65793 as rgb from l""",
    "row_means": f"with {MEANS} select row, round(g, 6) as g, round(b, 6) as b, round(r, 6) as r from means",
    "row_derivative": f"with {MEANS} select row, round(g, 6) as g, round(b, 6) as b, round(r, 6) as r from deriv",
    "lag_profile": f"with {profile('b', 4)} select delta, row, round(a, 6) as a, round(b, 6) as b from pairs",
    "normalized_corr": f"with {profile('r')} select delta, n, round(corr, 6) as corr from prof",
    "best_delta": f"with {profile('b')} select delta, round(corr, 6) as corr from prof order by prof.corr desc, delta limit 1",
    "top5_corr": f"""with {profile('b')} select row_number() over (order by prof.corr desc, delta) as rank, delta, round(corr, 6) as corr
from prof order by prof.corr desc, delta limit 5""",
    "auto_deltas": f"with {profile('b')}, bb as (select delta, corr from prof order by corr desc, delta limit 1)"
    + ", rp as (select delta, x.g as a, y.r as b from deltas, deriv x join deriv y on y.row = x.row + delta)"
    + ", rr as (select delta, covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) as corr from rp group by delta having count(*) >= 10 order by 2 desc, 1 limit 1)"
    + " select -bb.delta as bg_delta, round(bb.corr, 6) as bg_corr, rr.delta as gr_delta, round(rr.corr, 6) as gr_corr from bb, rr",
    # 8 x 90 screen over 22 columns, 22/8 source pixels per cell, scrolled 2 rows
    "viewport_bins": f"""with {PIXELS}, b as (
  select row, col, (row - 2) * 8 as ry, col * 8 as rx from px where row >= 2)
select row, col, dy, dx from (
  select row, col, (select max(n) from range(0, 90) t(n) where (n * 22) // 8 + 2 <= row) as dy,
    (select max(n) from range(0, 8) t(n) where (n * 22) // 8 <= col) as dx from b)
where row < (90 * 22) // 8 + 2""",
    "box_downsample": f"""with {SCALED}, cell as (
  select dy, dx, (dy * 22) // 8 + 2 as r0, ((dy + 1) * 22) // 8 + 2 as r1, (dx * 22) // 8 as c0, ((dx + 1) * 22) // 8 as c1
  from range(0, 90) a(dy) cross join range(0, 8) b(dx)),
s as (select dy, dx, sum(r) // count(*) as r, sum(g) // count(*) as g, sum(b) // count(*) as b
  from cell join sc on row >= r0 and row < r1 and col >= c0 and col < c1 group by dy, dx)
select dy, dx, coalesce(cast(r * 65536 + g * 256 + b as int), 3355443) as rgb from cell left join s using (dy, dx)""",
    # 88 x 60 screen over 22 columns at zoom 2: half a source pixel per cell
    "nearest_upsample": f"""with {SCALED} select dy, dx, coalesce((r << 16) + (g << 8) + b, 3355443) as rgb
from range(0, 60) a(dy) cross join range(0, 88) b(dx) left join sc on row = dy // 2 + 3 and col = dx // 2 + 1""",
    "scan_image": f"""with {SCALED}, {_shift('sc', '- 1', '+ 2')} select row, col, (r << 16) + (g << 8) + b as rgb from shifted""",
    "parse_sample_rate": """with t as (
  select event_id, user_id, cast(event_id % 9 as int) as n from events)
select event_id, user_id || ([' MHz', ' GHz', ' KHz', ' kHz', ' Hz', ' mhz', '', 'x MHz', '.5 MHz'])[n + 1] as text,
  case n when 0 then user_id * 1e6 when 1 then user_id * 1e9 when 2 then user_id * 1e3 when 3 then user_id * 1e3
    when 4 then cast(user_id as double) when 8 then (user_id + 0.5) * 1e6 end as hz from t""",
    "ns_to_us": "select event_id as seq, (event_id * 1000 + event_id % 1000) / 1000 as us from events",
    "parse_hex": f"with {COMMANDS} select seq, case when seq % 4 < 3 then mosi end as number from commands",
    "format_hex": f"""with {COMMANDS} select seq, printf('%02X', (mosi >> 16) & 127) as h2, printf('%04X', mosi & 65535) as h4,
  printf('0x%06X', mosi) as h6 from commands""",
    "capture_stats": "select 12 as total_probes, count(*) as total_samples, 1e8 as samplerate_hz, 1e-8 as sample_period, round(count(*) * 1e-8, 9) as duration_s from events",
    "asof_forward": f"""with {STROBE}, {CONTROL}, w as (select position * 1000 as t from st where d10 = 1 and prev = 0)
select w.t as t_ns, c.t as next_change from w asof left join (select distinct t from control) c on w.t <= c.t""",
}
