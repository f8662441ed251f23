"""Schemas of the two passenger manifests and of the house sales table."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Columns of the input files, in file order.
MANIFEST_A = StructType(
    [
        StructField("PassengerId", LongType(), True),
        StructField("Survived", IntegerType(), True),
        StructField("Pclass", IntegerType(), True),
        StructField("Name", StringType(), True),
        StructField("Sex", StringType(), True),
        StructField("Age", DoubleType(), True),
        StructField("SibSp", IntegerType(), True),
        StructField("Parch", IntegerType(), True),
        StructField("Ticket", StringType(), True),
        StructField("Fare", DoubleType(), True),
        StructField("Cabin", StringType(), True),
        StructField("Embarked", StringType(), True),
    ]
)

MANIFEST_B = StructType(
    [
        StructField("PassengerId", StringType(), True),
        StructField("HomePlanet", StringType(), True),
        StructField("CryoSleep", BooleanType(), True),
        StructField("Cabin", StringType(), True),
        StructField("Destination", StringType(), True),
        StructField("Age", DoubleType(), True),
        StructField("VIP", BooleanType(), True),
        StructField("RoomService", DoubleType(), True),
        StructField("FoodCourt", DoubleType(), True),
        StructField("ShoppingMall", DoubleType(), True),
        StructField("Spa", DoubleType(), True),
        StructField("VRDeck", DoubleType(), True),
        StructField("Name", StringType(), True),
        StructField("Transported", BooleanType(), True),
    ]
)

HOUSES = StructType(
    [
        StructField("Id", LongType(), True),
        StructField("MSSubClass", IntegerType(), True),
        StructField("MSZoning", StringType(), True),
        StructField("LotFrontage", DoubleType(), True),
        StructField("LotArea", DoubleType(), True),
        StructField("Street", StringType(), True),
        StructField("Alley", StringType(), True),
        StructField("LotShape", StringType(), True),
        StructField("LandContour", StringType(), True),
        StructField("Utilities", StringType(), True),
        StructField("LotConfig", StringType(), True),
        StructField("LandSlope", StringType(), True),
        StructField("Neighborhood", StringType(), True),
        StructField("Condition1", StringType(), True),
        StructField("Condition2", StringType(), True),
        StructField("BldgType", StringType(), True),
        StructField("HouseStyle", StringType(), True),
        StructField("OverallQual", IntegerType(), True),
        StructField("OverallCond", IntegerType(), True),
        StructField("YearBuilt", IntegerType(), True),
        StructField("YearRemodAdd", IntegerType(), True),
        StructField("RoofStyle", StringType(), True),
        StructField("RoofMatl", StringType(), True),
        StructField("Exterior1st", StringType(), True),
        StructField("Exterior2nd", StringType(), True),
        StructField("MasVnrType", StringType(), True),
        StructField("MasVnrArea", DoubleType(), True),
        StructField("ExterQual", StringType(), True),
        StructField("ExterCond", StringType(), True),
        StructField("Foundation", StringType(), True),
        StructField("BsmtQual", StringType(), True),
        StructField("BsmtCond", StringType(), True),
        StructField("BsmtExposure", StringType(), True),
        StructField("BsmtFinType1", StringType(), True),
        StructField("BsmtFinSF1", DoubleType(), True),
        StructField("BsmtFinType2", StringType(), True),
        StructField("BsmtFinSF2", DoubleType(), True),
        StructField("BsmtUnfSF", DoubleType(), True),
        StructField("TotalBsmtSF", DoubleType(), True),
        StructField("Heating", StringType(), True),
        StructField("HeatingQC", StringType(), True),
        StructField("CentralAir", StringType(), True),
        StructField("Electrical", StringType(), True),
        StructField("1stFlrSF", DoubleType(), True),
        StructField("2ndFlrSF", DoubleType(), True),
        StructField("LowQualFinSF", DoubleType(), True),
        StructField("GrLivArea", DoubleType(), True),
        StructField("BsmtFullBath", IntegerType(), True),
        StructField("BsmtHalfBath", IntegerType(), True),
        StructField("FullBath", IntegerType(), True),
        StructField("HalfBath", IntegerType(), True),
        StructField("Bedroom", IntegerType(), True),
        StructField("Kitchen", IntegerType(), True),
        StructField("KitchenQual", StringType(), True),
        StructField("TotRmsAbvGrd", IntegerType(), True),
        StructField("Functional", StringType(), True),
        StructField("Fireplaces", IntegerType(), True),
        StructField("FireplaceQu", StringType(), True),
        StructField("GarageType", StringType(), True),
        StructField("GarageYrBlt", IntegerType(), True),
        StructField("GarageFinish", StringType(), True),
        StructField("GarageCars", IntegerType(), True),
        StructField("GarageArea", DoubleType(), True),
        StructField("GarageQual", StringType(), True),
        StructField("GarageCond", StringType(), True),
        StructField("PavedDrive", StringType(), True),
        StructField("WoodDeckSF", DoubleType(), True),
        StructField("OpenPorchSF", DoubleType(), True),
        StructField("EnclosedPorch", DoubleType(), True),
        StructField("3SsnPorch", DoubleType(), True),
        StructField("ScreenPorch", DoubleType(), True),
        StructField("PoolArea", DoubleType(), True),
        StructField("PoolQC", StringType(), True),
        StructField("Fence", StringType(), True),
        StructField("MiscFeature", StringType(), True),
        StructField("MiscVal", DoubleType(), True),
        StructField("MoSold", IntegerType(), True),
        StructField("YrSold", IntegerType(), True),
        StructField("SaleType", StringType(), True),
        StructField("SaleCondition", StringType(), True),
        StructField("SalePrice", DoubleType(), True),
    ]
)
