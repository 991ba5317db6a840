"""Readers of classic and 64-bit NetCDF, NetCDF-4/HDF5 and HDF4 files, and the `cdm` data source over them."""
