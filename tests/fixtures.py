"""Small literal fixtures (no driver data)."""

from cohortlens.schemas import (DIM_GEOGRAPHY, DIM_WOMAN, FACT_ANC, FACT_BIRTH, FACT_MORTALITY,
                                WHO_MMR, WHO_SBA, Star)


def fanout_star(spark) -> Star:
    """Two women in one zone: W1 weight 2, facility delivery, three dead sisters
    (all pregnancy related); W2 weight 1, home delivery, no sisters."""
    geo = spark.createDataFrame([(1, 1, "Kano", "North West", "Urban")], DIM_GEOGRAPHY)
    woman = spark.createDataFrame([
        (1, "c1", 1, 30, "None", "Poorest", 1, 1, 2.0),
        (2, "c2", 1, 20, "Higher", "Rich", 0, 0, 1.0)], DIM_WOMAN)
    birth = spark.createDataFrame([(10, 1, 1, 2022, 1, "Home", 1)], FACT_BIRTH)
    anc = spark.createDataFrame([(100, 1, 4, 1, 1, "Doctor", 1),
                                 (200, 2, 0, None, 0, "None", 0)], FACT_ANC)
    mort = spark.createDataFrame([(1000 + i, 1, "Female", 0, 30.0 + i, 2.0, 1, 2020)
                                  for i in range(3)], FACT_MORTALITY)
    sba = spark.createDataFrame([(2024, 45.7, 46, "Nigeria", "MDG_0000000025")], WHO_SBA)
    mmr = spark.createDataFrame([(2023, 992.8, 718.3, 1540.0, "Nigeria", "MDG_0000000026")],
                                WHO_MMR)
    return Star(geography=geo, woman=woman, birth=birth, anc=anc, mortality=mort,
                who_sba=sba, who_mmr=mmr)


WIDE_DDL = (
    "caseid string, v001 int, sstate string, v024 string, v102 string, v012 int, v106 string, "
    "v190 string, v481 string, v467d string, v005 bigint, v008 int, "
    "bord_01 string, b2_01 string, b5_01 string, bord_02 string, b2_02 string, b5_02 string, "
    "bord_03 string, b2_03 string, b5_03 string, "
    "m15_1 string, m3a_1 string, m3b_1 string, m3c_1 string, m3d_1 string, m3e_1 string, "
    "m15_2 string, m3a_2 string, m3b_2 string, m3c_2 string, m3d_2 string, m3e_2 string, "
    "m14_1 string, m13_1 string, m70_1 string, "
    "mm1_01 string, mm2_01 string, mm4_01 string, mm8_01 string, mm9_01 string, "
    "mm1_02 string, mm2_02 string, mm4_02 string, mm8_02 string, mm9_02 string")


def wide_rows():
    """Five respondents; births in 3 slots (delivery data for 2), sisters in 2."""
    people = [
        # 3 births; recent one in a government hospital with a doctor;
        # sister 1: maternal death 36 months ago; sister 2: male
        dict(caseid="  1 1", v001=11, sstate="kano ", v024="north west", v102="urban", v012=25,
             v106="no education", v190="poorest", v481="no", v467d="big problem", v005=1500000,
             v008=1489, bord_01="3", b2_01="2023", b5_01="yes", bord_02="2", b2_02="2019",
             b5_02="no", bord_03="1", b2_03="2015", b5_03="dead",
             m15_1="government hospital", m3a_1="yes", m15_2="her home", m3d_2="yes",
             m14_1="no antenatal visits", m13_1="98", m70_1="yes",
             mm1_01="female", mm2_01="dead", mm4_01="1057", mm8_01="1453",
             mm9_01="died while pregnant",
             mm1_02="male", mm2_02="dead", mm4_02="1100", mm8_02="1470", mm9_02="violence"),
        # 1 birth at home, nobody attending; sister died 85 months ago (dropped)
        dict(caseid="  2 1", v001=12, sstate="Kano", v024="North West", v102="rural", v012=31,
             v106="2", v190="5", v481="1", v467d="3", v005=800000, v008=1489,
             bord_01="1", b2_01="2022", b5_01="1", m15_1="her home",
             m14_1="4.9", m13_1="3.5", m70_1="no",
             mm1_01="2", mm2_01="0", mm4_01="1000", mm8_01="1404", mm9_01="death not related"),
        # no births, no sisters
        dict(caseid="  3 1", v001=21, sstate="lagos", v024="south west", v102="urban", v012=40,
             v106="higher", v190="richer ", v481="yes", v467d="not a big problem",
             v005=1000000, v008=1488),
        # 2 births, private clinic with a nurse; alive sister (dropped)
        dict(caseid="  4 1", v001=21, sstate="Lagos", v024="South West", v102="Urban", v012=28,
             v106="1", v190="middle", v481="0", v467d="2", v005=1200000, v008=1488,
             bord_01="2", b2_01="2021", b5_01="yes", bord_02="1", b2_02="2018", b5_02="yes",
             m15_1="private clinic", m3b_1=" YES ", m15_2="mission", m3c_2="1",
             m14_1="8", m13_1="7", m70_1="1",
             mm1_01="female", mm2_01="alive", mm4_01="1000"),
        # 1 birth, place 'none' (anc row kept, facility unknown); recent maternal death
        dict(caseid="  5 1", v001=13, sstate="kano", v024="north west", v102="Rural", v012=19,
             v106="dk", v190="x", v481="dk", v467d="dk", v005=900000, v008=1489,
             bord_01="1", b2_01="2024", b5_01="x", m15_1="none", m3d_1="yes",
             m14_1="0", m13_1="x", m70_1="dk",
             mm1_01="female", mm2_01="no", mm4_01="1200", mm8_01="1480",
             mm9_01="6 weeks after delivery"),
    ]
    names = [p.split()[0] for p in WIDE_DDL.split(",")]
    return [tuple(p.get(n) for n in names) for p in people]


def wide_frame(spark):
    return spark.createDataFrame(wide_rows(), WIDE_DDL)
