"""Rule-based feature blocks."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import numeric as num
from tabforge.functions import text
from tabforge.functions.mapping import (
    DECK_ORDER,
    DECK_SCALE,
    FAMILY_SCALE,
    NOTEBOOK_TITLE_CODES,
    QUALITY_SCALE,
    RARE_DECKS,
    SEX_CODES,
    TITLE_CODES,
    TITLE_GROUPS,
    map_values,
    replace_values,
)
from tabforge.operators.columns import drop_cols
from tabforge.operators.lookup import group_size, lookup_fitted
from tabforge.operators.quantiles import fitted_quantiles
from tabforge.operators.stats import SKEW_THRESHOLD, grouped_max, skewed_columns, value_counts
from tabforge.plans.base import Configured, TableModel, setting

# Column names of the input files.
SPEND = ["RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck"]
LUXURY = ["Spa", "VRDeck", "RoomService"]
SUSTENANCE = ["FoodCourt", "ShoppingMall"]
NONE_CATEGORIES = [
    "Alley", "BsmtQual", "BsmtCond", "BsmtExposure", "BsmtFinType1", "BsmtFinType2",
    "FireplaceQu", "GarageType", "GarageFinish", "GarageQual", "GarageCond", "PoolQC",
    "Fence", "MiscFeature",
]
QUALITY_COLUMNS = [
    "ExterQual", "ExterCond", "BsmtQual", "BsmtCond", "HeatingQC", "KitchenQual",
    "FireplaceQu", "GarageQual", "GarageCond", "PoolQC",
]
AREAS = ["TotalBsmtSF", "1stFlrSF", "2ndFlrSF"]
BATHS = {"FullBath": 1.0, "HalfBath": 0.5, "BsmtFullBath": 1.0, "BsmtHalfBath": 0.5}
CHILD_BELOW = 13
SENIOR_ABOVE = 60
INTERACTIONS = ["quality_area", "quality_living", "quality_built", "quality_age"]


class SleepRule(Configured, Transformer):
    """Sleepers spend nothing; unknown sleep counts as awake."""

    spend_cols = setting("spend_cols", "spending columns")
    flag_col = setting("flag_col", "boolean sleep column")
    defaults = {"spend_cols": SPEND, "flag_col": "CryoSleep"}

    def _transform(self, df: DataFrame) -> DataFrame:
        asleep = num.fill_const(F.col(self.get("flag_col")), False)
        spends = {c: num.set_where(F.col(c), asleep, 0.0) for c in self.get("spend_cols")}
        return df.withColumns({**spends, self.get("flag_col"): asleep})


class AwakeFromSpend(Configured, Transformer):
    """Who spent money was awake, if sleep is unknown."""

    spend_cols = setting("spend_cols", "spending columns")
    flag_col = setting("flag_col", "boolean sleep column")
    defaults = {"spend_cols": SPEND, "flag_col": "CryoSleep"}

    def _transform(self, df: DataFrame) -> DataFrame:
        asleep = F.col(self.get("flag_col"))
        spent = num.row_sum([F.col(c) for c in self.get("spend_cols")]) > 0
        return df.withColumn(
            self.get("flag_col"), num.set_where(asleep, asleep.isNull() & spent, False)
        )


class _SpendSettings(Configured):
    spend_cols = setting("spend_cols", "spending columns")
    luxury = setting("luxury", "spending columns that count as luxury")
    sustenance = setting("sustenance", "spending columns that count as sustenance")
    age_col = setting("age_col", "age column")
    defaults = {
        "spend_cols": SPEND, "luxury": LUXURY, "sustenance": SUSTENANCE, "age_col": "Age",
    }


class SpendBlock(_SpendSettings, Estimator):
    """Totals, shares, spend per year, flags and logs. The median age is learned."""

    def _fit(self, df: DataFrame) -> "SpendBlockModel":
        age = self.get("age_col")
        return SpendBlockModel(
            age_median=fitted_quantiles(df, [age], [0.5])[age][0],
            **{name: self.get(name) for name in self.defaults},
        )


class SpendBlockModel(_SpendSettings, Model):
    age_median = setting("age_median", "median age of the fitted rows")

    def _transform(self, df: DataFrame) -> DataFrame:
        spend = self.get("spend_cols")
        age = F.col(self.get("age_col"))
        known_age = num.fill_const(age, self.get("age_median"))
        out = df.withColumns(
            {
                "total_spend": num.row_sum([F.col(c) for c in spend]),
                "luxury_spend": num.lin_comb([F.col(c) for c in self.get("luxury")]),
                "sustenance_spend": num.lin_comb([F.col(c) for c in self.get("sustenance")]),
            }
        )
        total = F.col("total_spend")
        out = out.withColumns(
            {
                "luxury_ratio": num.safe_ratio(F.col("luxury_spend"), total),
                "sustenance_ratio": num.safe_ratio(F.col("sustenance_spend"), total),
                "spend_power": num.spend_power(total, age, self.get("age_median")),
                "zero_spend": num.flag(total == 0),
                "is_child": num.flag(known_age < CHILD_BELOW),
                "is_senior": num.flag(known_age > SENIOR_ABOVE),
            }
        )
        logged = [*spend, "total_spend", "luxury_spend", "sustenance_spend", "spend_power"]
        return out.withColumns(
            {f"log_{c}": F.log1p(F.coalesce(F.col(c), F.lit(0))) for c in logged}
        )


class _SocialSettings(Configured):
    id_col = setting("id_col", "group_member id column")
    name_col = setting("name_col", "name column, surname last")
    cabin_col = setting("cabin_col", "deck/number/side column")
    defaults = {"id_col": "PassengerId", "name_col": "Name", "cabin_col": "Cabin"}


def _social_keys(stage: _SocialSettings, df: DataFrame) -> DataFrame:
    cabin = F.coalesce(F.col(stage.get("cabin_col")), F.lit(text.NO_CABIN))
    return df.withColumns(
        {
            "cabin_key": cabin,
            "cabin_parts": text.parse_cabin(cabin),
            "surname": text.surname(F.col(stage.get("name_col"))),
        }
    ).withColumn("deck", F.col("cabin_parts.deck"))


class SocialBlock(_SocialSettings, Estimator):
    """Travel group, family by surname, cabin sharing and place on the deck."""

    def _fit(self, df: DataFrame) -> "SocialBlockModel":
        keyed = _social_keys(self, df)
        decks = keyed.select("deck", F.col("cabin_parts.num").alias("deck_length"))
        return SocialBlockModel(
            tables={
                "surnames": value_counts(keyed, "surname").withColumnRenamed("n", "family_size"),
                "cabins": value_counts(keyed, "cabin_key").withColumnRenamed("n", "occupancy"),
                "decks": grouped_max(decks, ["deck"], "deck_length"),
            },
            **{name: self.get(name) for name in self.defaults},
        )


class SocialBlockModel(_SocialSettings, TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        group = text.parse_group(F.col(self.get("id_col")))
        number = F.col("cabin_parts.num")
        out = _social_keys(self, df).withColumns(
            {"travel_group": group["group"], "member": group["member"]}
        )
        out = group_size(out, "travel_group")
        out = lookup_fitted(out, self.tables["surnames"], ["surname"], {"family_size": 1})
        out = lookup_fitted(out, self.tables["cabins"], ["cabin_key"], {"occupancy": 1})
        out = lookup_fitted(out, self.tables["decks"], ["deck"])
        return out.withColumns(
            {
                "group_rank_norm": F.col("member") / F.col("group_size"),
                "is_solo": num.flag(F.col("group_size") == 1),
                "side": F.col("cabin_parts.side"),
                "cabin_region": num.bin_right(number, num.REGION_EDGES, open_ends=False, other=0),
                "relative_position": num.relative_position(number, F.col("deck_length")),
            }
        ).drop("cabin_key", "cabin_parts", "surname", "travel_group", "member", "deck_length")


class _MatrixSettings(Configured):
    spend_cols = setting("spend_cols", "spending columns")
    flag_col = setting("flag_col", "boolean sleep column")
    age_col = setting("age_col", "age column")
    defaults = {"spend_cols": SPEND, "flag_col": "CryoSleep", "age_col": "Age"}


class ClusterMatrix(_MatrixSettings, Estimator):
    """Gap-free numeric columns for clustering, written as ``m_<column>``."""

    def _fit(self, df: DataFrame) -> "ClusterMatrixModel":
        age = self.get("age_col")
        return ClusterMatrixModel(
            age_median=fitted_quantiles(df, [age], [0.5])[age][0],
            **{name: self.get(name) for name in self.defaults},
        )


class ClusterMatrixModel(_MatrixSettings, Model):
    age_median = setting("age_median", "median age of the fitted rows")

    def columns(self) -> list[str]:
        return [f"m_{c}" for c in [*self.get("spend_cols"), "total", self.get("age_col")]]

    def _transform(self, df: DataFrame) -> DataFrame:
        asleep = num.fill_const(F.col(self.get("flag_col")), False)
        spends = {
            c: F.when(asleep, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
            for c in self.get("spend_cols")
        }
        age = self.get("age_col")
        return df.withColumns(
            {
                **{f"m_{c}": F.log1p(spend) for c, spend in spends.items()},
                "m_total": F.log1p(num.row_sum(spends.values())),
                f"m_{age}": num.fill_const(F.col(age), self.get("age_median")),
            }
        )


class NoneCategories(Configured, Transformer):
    """A missing category means the house has no such thing."""

    cols = setting("cols", "columns to fill")
    defaults = {"cols": NONE_CATEGORIES}

    def _transform(self, df: DataFrame) -> DataFrame:
        present = [c for c in self.get("cols") if c in df.columns]
        return df.withColumns({c: num.fill_const(F.col(c), "None") for c in present})


class QualityScale(Configured, Transformer):
    """Ordered quality grades to numbers; missing and unknown grades are 0."""

    cols = setting("cols", "graded columns")
    scale = setting("scale", "grade to number")
    defaults = {"cols": QUALITY_COLUMNS, "scale": QUALITY_SCALE}

    def _transform(self, df: DataFrame) -> DataFrame:
        graded = [c for c, kind in df.dtypes if c in self.get("cols") and kind == "string"]
        return df.withColumns({c: map_values(F.col(c), self.get("scale"), 0) for c in graded})


class Deskew(Configured, Estimator):
    """log1p on the columns found skewed at fit."""

    cols = setting("cols", "numeric columns to look at")
    threshold = setting("threshold", "skewed above this")
    bias = setting("bias", "size of population skewness, or signed adjusted skewness")
    defaults = {"threshold": SKEW_THRESHOLD, "bias": True}

    def _fit(self, df: DataFrame) -> "DeskewModel":
        found = skewed_columns(df, self.get("cols"), self.get("bias"), self.get("threshold"))
        return DeskewModel(cols=[row["column"] for row in found.collect()])  # names only


class DeskewModel(Configured, Model):
    cols = setting("cols", "skewed columns, most skewed first")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.log1p(F.col(c)) for c in self.get("cols")})


class HouseBlock(Configured, Transformer):
    """Total area, ages, weighted bath count and quality interactions."""

    area_cols = setting("area_cols", "areas to add up; missing counts as 0")
    bath_weights = setting("bath_weights", "bath column to weight; missing propagates")
    quality_col = setting("quality_col", "overall quality")
    living_col = setting("living_col", "living area")
    built_col = setting("built_col", "year built")
    remodel_col = setting("remodel_col", "year of the last remodelling")
    ref_year = setting("ref_year", "year ages are counted to")
    interactions = setting("interactions", "products of the quality to add")
    cap = setting("cap", "upper clamp of the interactions, if any")
    defaults = {
        "area_cols": AREAS, "bath_weights": BATHS, "quality_col": "OverallQual",
        "living_col": "GrLivArea", "built_col": "YearBuilt", "remodel_col": "YearRemodAdd",
        "ref_year": num.REFERENCE_YEAR, "interactions": INTERACTIONS, "cap": None,
    }

    def _transform(self, df: DataFrame) -> DataFrame:
        baths = self.get("bath_weights")
        built, year = F.col(self.get("built_col")), self.get("ref_year")
        out = df.withColumns(
            {
                "total_area": num.row_sum([F.col(c) for c in self.get("area_cols")]),
                "total_bath": num.lin_comb([F.col(c) for c in baths], list(baths.values())),
                "built_age": num.years_since(built, year),
                "remodel_age": num.years_since(F.col(self.get("remodel_col")), year),
            }
        )
        quality = F.col(self.get("quality_col"))
        partners = {
            "quality_area": F.col("total_area"),
            "quality_living": F.col(self.get("living_col")),
            "quality_built": built,
            "quality_age": F.col("built_age"),
        }
        products = {name: quality * partners[name] for name in self.get("interactions")}
        if self.get("cap") is not None:
            products = {n: num.clip_upper(p, self.get("cap")) for n, p in products.items()}
        return out.withColumns(products) if products else out


class PassengerBlock(Configured, Transformer):
    """Title, family and deck of the first manifest, as categories and as codes."""

    family_scale = setting("family_scale", "family size to its code; other sizes give 0")
    defaults = {"family_scale": FAMILY_SCALE}

    def _transform(self, df: DataFrame) -> DataFrame:
        title = text.extract_title(F.col("Name"))
        merged = replace_values(title, TITLE_GROUPS)
        family = num.lin_comb([F.col("SibSp"), F.col("Parch"), F.lit(1)])
        sizes = {int(size): code for size, code in self.get("family_scale").items()}
        deck = text.deck_letter(F.col("Cabin"))
        return df.withColumns(
            {
                "title": merged,
                "title_code": map_values(merged, TITLE_CODES, 0),
                "title_group": map_values(title, NOTEBOOK_TITLE_CODES, 0),
                "sex_code": map_values(F.col("Sex"), SEX_CODES),
                "family_size": family,
                "family_scale": map_values(family.cast("int"), sizes, 0.0),
                "is_alone": num.flag(family == 1),
                "deck": replace_values(deck, RARE_DECKS),
                "deck_scale": map_values(text.deck_letter(F.col("Cabin"), None), DECK_SCALE),
            }
        )


class PassengerDeck(Configured, Transformer):
    """Order of the decks as a number; an unknown deck comes last."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("deck_order", map_values(F.col("deck"), DECK_ORDER, 8))


class MapCodes(Configured, Transformer):
    """Code tables per column; a value outside the table becomes NULL."""

    codes = setting("codes", "mapping per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: map_values(F.col(c), mapping) for c, mapping in self.get("codes").items()}
        )


class RightBins(Configured, Transformer):
    """Bin numbers with right-closed edges per column; NULL stays NULL."""

    edges = setting("edges", "edges per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: num.bin_right(F.col(c), edges) for c, edges in self.get("edges").items()}
        )


class LogColumns(Configured, Transformer):
    """Logarithms of columns: ``log1p``, or ``log_pos`` (0 where there is no logarithm)."""

    cols = setting("cols", "columns to replace by their logarithm")
    how = setting("how", "'log1p' or 'log_pos'")
    defaults = {"how": "log1p"}

    def _transform(self, df: DataFrame) -> DataFrame:
        log = F.log1p if self.get("how") == "log1p" else num.log_pos
        return df.withColumns({c: log(F.col(c)) for c in self.get("cols")})


class DropColumns(Configured, Transformer):
    """Drop helper columns; absent ones do not matter."""

    cols = setting("cols", "columns to drop")

    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_cols(df, self.get("cols"), tolerant=True)


class _FilledSettings(Configured):
    prefix = setting("prefix", "put in front of the names of the copies")
    log = setting("log", "take log1p of the copies")
    defaults = {"prefix": "m_", "log": True}


class FilledCopies(_FilledSettings, Estimator):
    """Gap-free copies of columns, for clusters and components; the columns keep their gaps."""

    cols = setting("cols", "numeric columns")

    def _fit(self, df: DataFrame) -> "FilledCopiesModel":
        found = fitted_quantiles(df, self.get("cols"), [0.5])
        return FilledCopiesModel(
            fills={c: q[0] if q else 0.0 for c, q in found.items()},
            prefix=self.get("prefix"), log=self.get("log"),
        )


class FilledCopiesModel(_FilledSettings, Model):
    fills = setting("fills", "median per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = {
            c: F.coalesce(F.col(c).cast("double"), F.lit(fill))
            for c, fill in self.get("fills").items()
        }
        return df.withColumns(
            {
                f"{self.get('prefix')}{c}": F.log1p(value) if self.get("log") else value
                for c, value in filled.items()
            }
        )
