"""gridloom: a Spark-native analytics engine for range-sensor voxel maps."""
