"""Table specifications.

Everything in the library is driven by a ``TableSpec``: which column is the record id, which is the
binary outcome, which columns are categories (with their domains and defaults), which columns carry
validation rules, which columns are dropped before modelling and how columns are grouped for display.
The ICU record table is one instance; the driver's tables are others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldRule:
    """Validation rule of one field: type, inclusive bounds, null policy, default, domain."""

    type: str  # 'int' | 'float' | 'str' | 'bool'
    min: float | None = None
    max: float | None = None
    allow_null: bool = True
    default: object = None
    values: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Category:
    values: tuple[str, ...]
    default: str | None


@dataclass(frozen=True)
class TableSpec:
    name: str
    id_col: str
    label_col: str | None = None
    categories: dict[str, Category] = field(default_factory=dict)
    rules: dict[str, FieldRule] = field(default_factory=dict)
    # columns removed before feature preparation (ids, empty header column, ...)
    drop_cols: tuple[str, ...] = ()
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # the four list columns: id, ranged column, category column, status column
    list_cols: tuple[str, str, str, str] | None = None
    list_defaults: dict[str, object] = field(default_factory=dict)
    # ids that are shown but never edited
    read_only: tuple[str, ...] = ()
    # numeric feature columns in fixed order (serving fills the missing ones with 0)
    numeric_features: tuple[str, ...] = ()
    # how a default record fills other id columns: 'next' = max + 1, 'first' = value of the first record
    new_row_ids: dict[str, str] = field(default_factory=dict)
    # search-box labels of category values (label -> stored code) and the label meaning "no restriction"
    category_labels: dict[str, str] = field(default_factory=dict)
    all_label: str = "ALL"

    def group(self, name: str) -> list[str]:
        return list(self.groups[name])

    def defaults(self) -> dict[str, object]:
        """Default value per field: category default, then rule default, then None."""
        out: dict[str, object] = {}
        for c, r in self.rules.items():
            out[c] = r.default
        for c, cat in self.categories.items():
            out[c] = cat.default
        return out

    def with_metadata(self, schema: T.StructType) -> T.StructType:
        """Attach rules, domains and groups to the schema as field metadata."""
        group_of = {c: g for g, cols in self.groups.items() for c in cols}
        fields = []
        for f in schema.fields:
            md = dict(f.metadata or {})
            if f.name in self.rules:
                r = self.rules[f.name]
                md["rule"] = {"type": r.type, "min": r.min, "max": r.max, "allow_null": r.allow_null}
            if f.name in self.categories:
                md["values"] = list(self.categories[f.name].values)
                md["default"] = self.categories[f.name].default
            if f.name in group_of:
                md["group"] = group_of[f.name]
            fields.append(T.StructField(f.name, f.dataType, f.nullable, md))
        return T.StructType(fields)


# ---------------------------------------------------------------------------------------------
# Fixed values of the ICU record table. These must equal the original application's rules,
# domains and groups for the same validation and display results; they are listed as given.
# ---------------------------------------------------------------------------------------------

_FLAGS = (
    "elective_surgery", "apache_post_operative", "arf_apache", "gcs_unable_apache", "intubated_apache",
    "ventilated_apache", "aids", "cirrhosis", "diabetes_mellitus", "hepatic_failure", "immunosuppression",
    "leukemia", "lymphoma", "solid_tumor_with_metastasis",
)

ICU_RULES: dict[str, FieldRule] = {
    "age": FieldRule("int", 0, 130),
    "bmi": FieldRule("float", 0, 100),
    "height": FieldRule("float", 0, 300),
    "weight": FieldRule("float", 0, 500),
    "pre_icu_los_days": FieldRule("float", 0, None),
    "apache_2_diagnosis": FieldRule("int", 0, None),
    "apache_3j_diagnosis": FieldRule("float", 0, None),
    "gcs_eyes_apache": FieldRule("int", 0, 4),
    "gcs_motor_apache": FieldRule("int", 0, 6),
    "gcs_verbal_apache": FieldRule("int", 0, 5),
    "heart_rate_apache": FieldRule("int", 0, 300),
    "map_apache": FieldRule("int", 0, 300),
    "resprate_apache": FieldRule("int", 0, 100),
    "temp_apache": FieldRule("float", 25, 45),
    "hospital_death": FieldRule("int", 0, 1),
    **{f: FieldRule("int", 0, 1) for f in _FLAGS},
}

ICU_CATEGORIES: dict[str, Category] = {
    "ethnicity": Category(("African American", "Asian", "Caucasian", "Hispanic", "Native American",
                           "Other/Unknown", "Unknown"), "Unknown"),
    "gender": Category(("F", "M", "Unknown"), "Unknown"),
    "icu_admit_source": Category(("Accident & Emergency", "Floor", "Operating Room / Recovery",
                                  "Other Hospital", "Other ICU", "Unknown"), "Unknown"),
    "icu_stay_type": Category(("admit", "readmit", "transfer"), "admit"),
    "icu_type": Category(("CCU-CTICU", "CSICU", "CTICU", "Cardiac ICU", "MICU", "Med-Surg ICU",
                          "Neuro ICU", "SICU"), "MICU"),
    "apache_2_bodysystem": Category(("Cardiovascular", "Gastrointestinal", "Haematologic", "Metabolic",
                                     "Neurologic", "Renal/Genitourinary", "Respiratory", "Trauma",
                                     "Undefined Diagnoses", "Undefined diagnoses", "Unknown"), "Unknown"),
    "apache_3j_bodysystem": Category(("Cardiovascular", "Gastrointestinal", "Genitourinary", "Gynecological",
                                      "Hematological", "Metabolic", "Musculoskeletal/Skin", "Neurological",
                                      "Respiratory", "Sepsis", "Trauma", "Unknown"), "Unknown"),
}

ICU_GROUPS: dict[str, tuple[str, ...]] = {
    "basic": ("patient_id", "encounter_id", "hospital_id", "age", "gender", "height", "weight", "bmi",
              "ethnicity"),
    "icu": ("icu_id", "icu_type", "icu_admit_source", "icu_stay_type", "pre_icu_los_days", "elective_surgery"),
    "apache": ("apache_2_diagnosis", "apache_3j_diagnosis", "apache_post_operative", "apache_2_bodysystem",
               "apache_3j_bodysystem", "arf_apache", "gcs_eyes_apache", "gcs_motor_apache", "gcs_verbal_apache",
               "gcs_unable_apache", "heart_rate_apache", "intubated_apache", "map_apache", "resprate_apache",
               "temp_apache", "ventilated_apache"),
    "day1_vitals": ("d1_diasbp_max", "d1_diasbp_min", "d1_diasbp_noninvasive_max", "d1_diasbp_noninvasive_min",
                    "d1_heartrate_max", "d1_heartrate_min", "d1_mbp_max", "d1_mbp_min", "d1_mbp_noninvasive_max",
                    "d1_mbp_noninvasive_min", "d1_resprate_max", "d1_resprate_min", "d1_spo2_max", "d1_spo2_min",
                    "d1_sysbp_max", "d1_sysbp_min", "d1_sysbp_noninvasive_max", "d1_sysbp_noninvasive_min",
                    "d1_temp_max", "d1_temp_min"),
    "hour1_vitals": ("h1_diasbp_max", "h1_diasbp_min", "h1_diasbp_noninvasive_max", "h1_diasbp_noninvasive_min",
                     "h1_heartrate_max", "h1_heartrate_min", "h1_mbp_max", "h1_mbp_min", "h1_mbp_noninvasive_max",
                     "h1_mbp_noninvasive_min", "h1_resprate_max", "h1_resprate_min", "h1_spo2_max", "h1_spo2_min",
                     "h1_sysbp_max", "h1_sysbp_min", "h1_sysbp_noninvasive_max", "h1_sysbp_noninvasive_min"),
    "labs": ("d1_glucose_max", "d1_glucose_min", "d1_potassium_max", "d1_potassium_min"),
    "comorbidities": ("aids", "cirrhosis", "diabetes_mellitus", "hepatic_failure", "immunosuppression", "leukemia",
                      "lymphoma", "solid_tumor_with_metastasis"),
    "outcome": ("apache_4a_hospital_death_prob", "apache_4a_icu_death_prob", "hospital_death"),
}

# status text shown for a record without a status column (the original shows "alive")
ICU_STATUS_DEFAULT = "存活"

_ICU_ID_LIKE = ("patient_id", "encounter_id", "hospital_id", "icu_id")


def _icu_numeric_features() -> tuple[str, ...]:
    cols = [c for g in ICU_GROUPS.values() for c in g]
    return tuple(c for c in cols if c not in ICU_CATEGORIES and c not in _ICU_ID_LIKE and c != "hospital_death")


ICU = TableSpec(
    name="icu_records",
    id_col="patient_id",
    label_col="hospital_death",
    categories=ICU_CATEGORIES,
    rules=ICU_RULES,
    drop_cols=("encounter_id", "patient_id", "hospital_id", "icu_id", "_c83"),
    groups=ICU_GROUPS,
    list_cols=("patient_id", "age", "gender", "status"),
    list_defaults={"status": ICU_STATUS_DEFAULT, "patient_id": "", "age": "", "gender": ""},
    read_only=("patient_id", "encounter_id", "hospital_id"),
    numeric_features=_icu_numeric_features(),
    new_row_ids={"encounter_id": "next", "hospital_id": "first"},
    # the original search box offers these labels ("all", "male", "female")
    category_labels={"男": "M", "女": "F"},
    all_label="全部",
)


def icu_schema() -> T.StructType:
    """Typed schema of the ICU record file, in group order, plus the unnamed trailing column."""
    fields = []
    for c in [c for g in ICU_GROUPS.values() for c in g]:
        if c in ICU_CATEGORIES:
            t = T.StringType()
        elif c in _ICU_ID_LIKE:
            t = T.LongType()
        elif c in ICU_RULES and ICU_RULES[c].type == "int":
            t = T.IntegerType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(c, t, True))
    fields.append(T.StructField("_c83", T.StringType(), True))
    return ICU.with_metadata(T.StructType(fields))


# ---------------------------------------------------------------------------------------------
# Stand-in specs over the driver's tables.
# ---------------------------------------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

CUSTOMER = TableSpec(
    name="customer",
    id_col="c_custkey",
    categories={"c_mktsegment": Category(SEGMENTS, "BUILDING")},
    rules={
        "c_acctbal": FieldRule("float", -1000, 10000),
        "c_nationkey": FieldRule("int", 0, 24),
        "c_name": FieldRule("str"),
    },
    groups={"basic": ("c_custkey", "c_name", "c_mktsegment"), "finance": ("c_nationkey", "c_acctbal")},
    list_cols=("c_custkey", "c_acctbal", "c_mktsegment", "status"),
    list_defaults={"status": "active"},
    read_only=("c_custkey",),
)

ORDERS = TableSpec(
    name="orders",
    id_col="o_orderkey",
    label_col="is_finished",
    categories={
        "o_orderstatus": Category(("F", "O", "P"), "O"),
        "o_orderpriority": Category(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "5-LOW"),
    },
    rules={
        "o_custkey": FieldRule("int", 0, None),
        "o_totalprice": FieldRule("float", 0, 500000),
        "o_orderstatus": FieldRule("str", values=("F", "O", "P")),
    },
    groups={"keys": ("o_orderkey", "o_custkey"), "order": ("o_orderstatus", "o_totalprice", "o_orderpriority")},
    read_only=("o_orderkey",),
)

LINEITEM = TableSpec(
    name="lineitem",
    id_col="l_orderkey",  # not unique: only key-free operators use this spec
    label_col="big_sale",
    categories={"l_returnflag": Category(("A", "N", "R"), "N"), "l_linestatus": Category(("F", "O"), "O")},
    rules={"l_quantity": FieldRule("float", 0, 100), "l_discount": FieldRule("float", 0, 1),
           "l_tax": FieldRule("float", 0, 1)},
    drop_cols=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
    groups={"pricing": ("l_extendedprice", "l_discount", "l_tax"), "flags": ("l_returnflag", "l_linestatus"),
            "keys": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")},
    numeric_features=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
)

EVENTS = TableSpec(
    name="events",
    id_col="event_id",
    label_col="is_error",
    categories={"event_type": Category(("click", "error", "purchase", "signup", "view"), "view")},
    drop_cols=("event_id", "user_id", "ts", "props", "event_type"),
    numeric_features=("value", "hour"),
)
