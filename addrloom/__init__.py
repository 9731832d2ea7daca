"""addrloom: a PySpark-native engine for cleaning, matching and analysing postal addresses."""
