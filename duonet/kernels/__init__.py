"""Dense numeric kernels in numpy; none of them imports Spark."""
