from cellgrid.functions import distributions  # registers its functions
