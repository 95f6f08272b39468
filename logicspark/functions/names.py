"""Dimension tables for command annotation: 128 registers at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Registers of the timing bank.
TIMING = {
    0x00: "CCD_CLK_PHASE_00",
    0x01: "CCD_CLK_PHASE_01",
    0x02: "CCD_CLK_PHASE_02",
    0x03: "CCD_CLK_PHASE_03",
    0x04: "CCD_CLK_PHASE_04",
    0x05: "CCD_CLK_PHASE_05",
    0x06: "CCD_CLK_PHASE_06",
    0x07: "CCD_CLK_PHASE_07",
    0x08: "CCD_CLK_PHASE_08",
    0x09: "CCD_CLK_PHASE_09",
    0x0A: "CCD_CLK_PHASE_0A",
    0x0B: "CCD_CLK_PHASE_0B",
    0x0C: "CCD_CLK_PHASE_0C",
    0x0D: "CCD_CLK_PHASE_0D",
    0x0E: "CCD_CLK_PHASE_0E",
    0x0F: "CCD_CLK_PHASE_0F",
    0x10: "CCD_CLK_PHASE_10",
    0x11: "CCD_CLK_PHASE_11",
    0x12: "CCD_CLK_PHASE_12",
    0x13: "CCD_CLK_PHASE_13",
    0x14: "CCD_CLK_PHASE_14",
    0x15: "CCD_CLK_PHASE_15",
    0x16: "CCD_CLK_TRANS_A",
    0x17: "CCD_CLK_TRANS_B",
    0x18: "LINE_TIMING_18",
    0x19: "LINE_TIMING_19",
    0x1A: "LINE_TIMING_1A",
    0x1B: "LINE_TIMING_1B",
    0x1C: "LINE_TIMING_1C",
    0x1D: "LINE_TIMING_1D",
    0x1E: "LINE_TIMING_1E",
    0x1F: "LINE_TIMING_1F",
    0x20: "LINE_TIMING_20",
    0x21: "LINE_TIMING_21",
    0x22: "LINE_TIMING_22",
    0x23: "TIMING_23",
    0x24: "TIMING_24",
    0x25: "TIMING_25",
    0x26: "TIMING_26",
    0x27: "TIMING_27",
    0x28: "TIMING_28",
    0x29: "TIMING_29",
    0x2A: "TIMING_2A",
    0x2B: "TIMING_2B",
    0x2C: "TIMING_2C",
    0x2D: "TIMING_2D",
    0x2E: "CONFIG_FLAGS_A",
    0x2F: "CONFIG_FLAGS_B",
    0x30: "CDS_GAIN_30",
    0x31: "CDS_GAIN_31",
    0x32: "CDS_GAIN_32",
    0x33: "CDS_GAIN_33",
    0x34: "CDS_GAIN_34",
    0x35: "CDS_GAIN_35",
    0x36: "CDS_GAIN_ALT_A",
    0x37: "CDS_GAIN_ALT_B",
    0x38: "CLAMP_OFFSET_38",
    0x39: "CLAMP_OFFSET_39",
    0x3A: "CLAMP_OFFSET_3A",
    0x3B: "CLAMP_OFFSET_3B",
    0x3C: "CHANNEL_CFG_3C",
    0x3D: "CHANNEL_CFG_3D",
    0x3E: "CHANNEL_CFG_3E",
    0x3F: "CHANNEL_CFG_3F",
}
# Registers of the control bank.
CONTROL = {
    0x44: "EXT_CFG_44",
    0x45: "EXT_CFG_45",
    0x46: "EXT_CFG_46",
    0x47: "EXT_CFG_47",
    0x50: "PIXEL_START_POS",
    0x51: "PIXEL_END_POS",
    0x52: "LED_EXPOSURE",
    0x53: "LED_TIMING",
    0x56: "LED_CTRL_A",
    0x57: "LED_CTRL_B",
    0x58: "EXT_CFG_58",
    0x59: "EXT_CFG_59",
    0x5A: "EXT_CFG_5A",
    0x5B: "EXT_CFG_5B",
    0x5C: "EXT_CFG_5C",
    0x60: "STREAM_CTRL",
    0x61: "AFE_MODE",
    0x62: "RGB_SEQUENCER",
    0x63: "SYSTEM_MODE",
    0x64: "EXT_CFG_64",
    0x65: "EXT_CFG_65",
    0x66: "EXT_CFG_66",
    0x67: "PGA_CONFIG",
    0x68: "DATA_BUS_CFG",
    0x69: "EXT_CFG_69",
    0x6A: "SCAN_CTRL",
    0x6B: "VREF_BIAS_DAC",
    0x6F: "EXT_CFG_6F",
    0x70: "EXT_CFG_70",
    0x72: "EXT_CFG_72",
    0x78: "RED_GAIN_OFFSET",
    0x79: "GREEN_GAIN_OFFSET",
    0x7A: "BLUE_GAIN_OFFSET",
    0x7E: "EXT_CFG_7E",
    0x7F: "EXT_CFG_7F",
}
# Fully known commands.
SPECIAL = {
    0x600081: "START pixel stream from CCD",
    0x600080: "Set stream mode config",
    0x600000: "STOP pixel stream",
    0x630001: "BEGIN config sequence",
    0x630002: "BEGIN scan/acquisition mode",
    0x630004: "BEGIN register readback/verify",
    0x630000: "END mode / idle",
    0x6A0000: "Scan line reset/prepare",
    0x68FFFF: "Enable full 16-bit pixel data output",
    0x680100: "Set config-mode data bus",
}
# Sequencer commands.
SEQUENCER = {0x020E: "setup", 0x02CE: "red timing", 0x00C6: "green timing", 0x0486: "blue timing"}


def _table(spark: SparkSession, rows: dict[int, str], key: str, key_type: str, name: str) -> DataFrame:
    values = ", ".join(f"({k}, '{text}')" for k, text in sorted(rows.items()))
    return spark.sql(f"SELECT CAST(k AS {key_type}) AS {key}, v AS {name} FROM VALUES {values} AS t(k, v)")


def timing_names(spark: SparkSession) -> DataFrame:
    return _table(spark, TIMING, "timing_register", "INT", "timing_name")


def control_names(spark: SparkSession) -> DataFrame:
    return _table(spark, CONTROL, "control_register", "INT", "control_name")


def special_names(spark: SparkSession) -> DataFrame:
    return _table(spark, SPECIAL, "special_mosi", "BIGINT", "special")


def sequencer_names(spark: SparkSession) -> DataFrame:
    return _table(spark, SEQUENCER, "sequencer_value", "INT", "sequencer")
