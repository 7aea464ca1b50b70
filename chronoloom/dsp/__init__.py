"""Signal kernels in numpy, and their plans over tables of sample chunks."""
