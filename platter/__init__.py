"""platter: disk images, archives, flux captures and virtual volumes as Spark DataFrames."""
