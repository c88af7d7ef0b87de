"""hoopframe: a PySpark library of operators over player-game logs."""
