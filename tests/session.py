from pyspark.sql import SparkSession


def session(cores: str = "8"):
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("hoopframe-tests")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
