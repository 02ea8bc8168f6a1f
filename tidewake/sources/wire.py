"""C structs in binary columns: layouts compiled from field lists, and column expressions that read them.

A layout is a list of (name, type) or (name, type, count). Types are u8, i8, u16, i16, u32, i32, u64, i64, f32, f64,
char (text of ``count`` bytes that ends at a zero) and other layouts. Fields stand at multiples of their
alignment and a struct's size is one of its own, as C compilers have it; numbers are little-endian. Reading needs no Python
code in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "f32": 4, "u64": 8, "i64": 8, "f64": 8, "char": 1}


@dataclass(frozen=True)
class Layout:
    """Fields with their places: (name, type, count, offset); count is None for a single value."""

    fields: tuple[tuple[str, str | Layout, int | None, int], ...]
    size: int
    align: int


def layout(*members: tuple) -> Layout:
    """Places of ``members`` with C padding."""
    out, at, widest = [], 0, 1
    for name, kind, *count in members:
        size, align = (kind.size, kind.align) if isinstance(kind, Layout) else (SIZES[kind], SIZES[kind])
        at = -(-at // align) * align
        out.append((name, kind, count[0] if count else None, at))
        at, widest = at + size * (count[0] if count else 1), max(widest, align)
    return Layout(tuple(out), -(-at // widest) * widest, widest)


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, which is computed once however often ``body`` uses it: Spark doesn't share what is inside lambdas."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _digits(text: Column, at: Column, size: int) -> Column:
    """Hex digits of ``size`` bytes at byte ``at``, the highest byte first."""
    pairs = [F.substring(text, 2 * at + (2 * i + 1), F.lit(2)) for i in reversed(range(size))]
    return pairs[0] if size == 1 else F.concat(*pairs)


def _number(text: Column, at: Column, kind: str) -> Column:
    """The number of ``kind`` at byte ``at`` of the hex digits ``text``: a decimal for u64, else a long or a double."""
    size = SIZES[kind]
    digits = _digits(text, at, size)
    if kind.startswith("f"):
        return _let(digits, lambda d: _float(d, 8 if kind == "f32" else 11, 23 if kind == "f32" else 52))
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if kind == "u64":
        return value
    if kind.startswith("i"):
        whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
        value = _let(value, lambda v: F.when(v >= whole(1 << (8 * size - 1)), v - whole(1 << 8 * size)).otherwise(v))
    return value.cast("long")


def _float(digits: Column, exponent_bits: int, fraction_bits: int) -> Column:
    """An IEEE 754 number from its hex digits: sign, exponent and fraction are numbers that a double holds exactly.

    The first three digits hold the sign, the exponent and, of a float, the first bits of the fraction.
    """
    rest = exponent_bits + fraction_bits + 1 - 12
    shift = 11 - exponent_bits
    head, low = F.conv(F.substring(digits, 1, 3), 16, 10).cast("long"), F.conv(F.substring(digits, 4, rest // 4), 16, 10).cast("double")
    bias = (1 << (exponent_bits - 1)) - 1

    def number(x: Column) -> Column:
        head, exponent, part = x["head"], x["exponent"], x["part"]
        sign = F.when(head >= 1 << 11, -1.0).otherwise(1.0)
        # two factors, as not all powers of two that take part are doubles themselves
        power = F.greatest(exponent, F.lit(1)) - bias
        half = F.floor(power / 2)
        size = (F.when(exponent > 0, 1.0).otherwise(0.0) + part) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
        return F.when(exponent < (1 << exponent_bits) - 1, sign * size).when(part == 0, sign * float("inf")).otherwise(F.lit(float("nan")))

    def split(x: Column) -> Column:
        part = ((x["head"] % (1 << shift)).cast("double") * float(1 << rest) + x["low"]) / float(1 << fraction_bits)
        return _let(F.struct(x["head"].alias("head"), (F.shiftright(x["head"], shift) % (1 << exponent_bits)).alias("exponent"), part.alias("part")), number)

    return _let(F.struct(head.alias("head"), low.alias("low")), split)


def _leaves(shape: Layout, at: int = 0) -> list[tuple[str, int]]:
    """(type, offset) of all numbers of ``shape``, reserved and padding ones left out."""
    out = []
    for name, kind, count, offset in shape.fields:
        if _filler(name) or kind == "char":
            continue
        for i in range(count or 1):
            if isinstance(kind, Layout):
                out += _leaves(kind, at + offset + i * kind.size)
            else:
                out.append((kind, at + offset + i * SIZES[kind]))
    return out


def _filler(name: str) -> bool:
    return name.startswith(("reserved", "pad"))


def decoded(blobs: DataFrame, shape: Layout, column: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` of ``blobs`` and the fields of the struct in the binary ``column``; reserved and padding fields are left out.

    Fields are null where the content is null or shorter than the struct. u64 numbers are decimals, other whole ones longs. The numbers of a
    type are read by one expression over their places, so plans stay small for large structs.
    """
    leaves = _leaves(shape)
    places = {k: sorted({o for t, o in leaves if t == k}) for k in dict.fromkeys(t for t, _ in leaves)}
    text, whole = "_hex", "_numbers"

    def reader(digits: Column, kind: str) -> Callable[[Column], Column]:
        return lambda o: _number(digits, o, kind)

    def read(digits: Column) -> Column:
        numbers = (F.transform(F.array(*map(F.lit, at)), reader(digits, k)).alias(k) for k, at in places.items())
        return F.struct(digits.alias(text), F.when(digits.isNotNull(), F.struct(*numbers)).alias(whole))

    def value(of: Column, kind: str | Layout, count: int | None, at: int) -> Column:
        if kind == "char":
            return F.substring_index(F.make_valid_utf8(F.unhex(F.substring(of[text], 2 * at + 1, 2 * (count or 1))).cast("string")), "\0", 1)
        if count is not None:
            size = kind.size if isinstance(kind, Layout) else SIZES[kind]
            return F.array(*(value(of, kind, None, at + i * size) for i in range(count)))
        if isinstance(kind, Layout):
            return F.struct(*(value(of, k, n, at + o).alias(name) for name, k, n, o in kind.fields if not _filler(name)))
        return F.get(of[whole][kind], F.lit(places[kind].index(at)))

    def fields(of: Column) -> Column:
        return F.struct(*(F.when(of[text].isNotNull(), value(of, kind, count, at)).alias(name) for name, kind, count, at in shape.fields if not _filler(name)))

    digits = F.when(F.length(column) >= shape.size, F.hex(column))
    return blobs.select(*keep, F.inline(F.transform(F.transform(F.array(digits), read), fields)))


# The layouts of the messages on the bus and of trace records, and the names of their states.
NAV_STATE = layout(
    ("t_ns", "u64"), ("pos", "f64", 3), ("vel", "f64", 3), ("rpy", "f64", 3), ("depth", "f64"), ("omega_b", "f64", 3), ("acc_b", "f64", 3), ("age_ms", "u32"), ("valid", "u8"), ("stale", "u8"), ("degraded", "u8"),
    ("nav_state", "u8"), ("health", "u8"), ("reserved0", "u8"), ("fault_code", "u16"), ("sensor_mask", "u16"), ("status_flags", "u16"), ("reserved1", "u16"),
)
DOF_COMMAND = layout(("surge", "f64"), ("sway", "f64"), ("heave", "f64"), ("roll", "f64"), ("pitch", "f64"), ("yaw", "f64"))
MOTOR_TEST_COMMAND = layout(("enable", "u8"), ("motor_id", "u8"), ("mode", "u8"), ("reserved0", "u8"), ("value", "f32"), ("duration_ms", "u16"), ("reserved1", "u16"), ("cmd_id", "u32"))
CONTROL_INTENT = layout(
    ("version", "u32"), ("flags", "u32"), ("cmd_seq", "u64"), ("stamp_ns", "u64"), ("ttl_ms", "u32"), ("source_id", "u8"), ("source_prio", "u8"), ("pad_src", "u16"), ("request_exit", "u8"), ("estop", "u8"), ("clear_estop", "u8"),
    ("arm", "u8"), ("disarm", "u8"), ("pad0", "u8"), ("pad1", "u8"), ("pad2", "u8"), ("mode_request", "u8"), ("pad3", "u8", 7), ("teleop_dof_cmd", DOF_COMMAND), ("motor_test", MOTOR_TEST_COMMAND), ("reserved0", "u32"), ("reserved1", "u32"),
)
MOTOR_TEST_STATE = layout(("active", "u8"), ("motor_id", "u8"), ("mode", "u8"), ("reserved0", "u8"), ("value", "f32"), ("remaining_ms", "u32"), ("cmd_id", "u32"))
INTENT_STATE = layout(
    ("intent_id", "u64"), ("session_id", "u64"), ("cmd_seq", "u64"), ("stamp_ns", "u64"), ("ttl_ms", "u32"), ("source", "u8"), ("requested_mode", "u8"), ("arm_cmd", "u8"), ("estop_cmd", "u8"), ("valid", "u8"), ("reserved0", "u8", 3),
    ("dof_cmd", "f32", 6), ("motor_test", MOTOR_TEST_STATE),
)
CONTROL_STATE = layout(
    ("active_mode", "u8"), ("armed", "u8"), ("estop_latched", "u8"), ("failsafe_active", "u8"), ("control_source", "u8"), ("intent_fresh", "u8"), ("controller_status", "u8"), ("motor_test_active", "u8"), ("active_intent_id", "u64"),
    ("controller_name", "char", 32), ("desired_controller", "char", 32), ("dof_cmd_applied", "f32", 6), ("thruster_cmd", "f32", 8), ("pwm_duty", "f32", 8), ("consecutive_failures", "u32"), ("auto_fail_limit", "u32"),
)
SYSTEM_STATE = layout(
    ("session_state", "u8"), ("nav_state", "u8"), ("stm32_link_state", "u8"), ("pwm_link_state", "u8"), ("health_state", "u8"), ("degraded", "u8"), ("fault_state", "u8"), ("reserved0", "u8"), ("last_fault_code", "u16"), ("nav_fault_code", "u16"),
    ("nav_status_flags", "u16"), ("reserved1", "u16"), ("heartbeat_age_ms", "u32"), ("nav_age_ms", "u32"), ("nav_valid", "u8"), ("nav_health", "u8"), ("nav_stale", "u8"), ("nav_degraded", "u8"), ("session_id", "u64"), ("stm32_last_rtt_ms", "f32"),
    ("pwm_tx_frames", "u64"), ("stm32_hb_tx", "u64"), ("stm32_hb_ack", "u64"),
)
COMMAND_RESULT = layout(("intent_id", "u64"), ("cmd_seq", "u64"), ("stamp_ns", "u64"), ("event_code", "u16"), ("fault_code", "u16"), ("status", "u8"), ("source", "u8"), ("reserved0", "u8", 6))
EVENT_RECORD = layout(("seq", "u64"), ("stamp_ns", "u64"), ("event_code", "u16"), ("fault_code", "u16"), ("arg0", "i32"), ("arg1", "i32"))
TELEMETRY_FRAME_V2 = layout(
    ("version", "u32"), ("payload_size", "u32"), ("seq", "u64"), ("stamp_ns", "u64"), ("valid", "u8"), ("source", "u8"), ("reserved0", "u16"), ("intent", INTENT_STATE), ("control", CONTROL_STATE), ("system", SYSTEM_STATE), ("attitude_rpy", "f32", 3),
    ("position", "f32", 3), ("velocity", "f32", 3), ("depth_m", "f32"), ("last_command_result", COMMAND_RESULT), ("last_event", EVENT_RECORD), ("event_count", "u32"), ("event_head", "u32"), ("events", EVENT_RECORD, 16),
)
TRACE_RECORD = layout(("version", "u8"), ("kind", "u8"), ("flags", "u16"), ("reserved0", "u32"), ("sensor_time_ns", "i64"), ("recv_mono_ns", "i64"), ("consume_mono_ns", "i64"), ("publish_mono_ns", "i64"), ("age_ms", "u32"), ("fault_code", "u32"))
