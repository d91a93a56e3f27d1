"""sensorframe: labelled multi-sensor runs on Spark DataFrames."""
