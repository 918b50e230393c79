"""Louvain's loops, and strong components, as functions of Spark's JVM: they are sequential by definition, and kernels.louvain takes
some ten times as long (20,000 files: 9.0 s against 0.85 s with the job around it). The source is compiled by the compiler that Spark brings for its own plans; executors get it as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession

#: What kernels.louvain does, in the same order and with the same operations on doubles. The bytes hold 32-bit starts and
#: neighbours and 64-bit weights of kernels._Level, little-endian; the result holds a 32-bit group for each node.
LOUVAIN = """
package trellis;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;

public class Louvain implements org.apache.spark.sql.api.java.UDF4 {
    static int[] ints(byte[] b) {
        int[] out = new int[b.length / 4];
        ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().get(out);
        return out;
    }

    static double[] doubles(byte[] b) {
        double[] out = new double[b.length / 8];
        ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN).asDoubleBuffer().get(out);
        return out;
    }

    static int[] settled(int n, int[] starts, int[] others, double[] weights, double total) {
        int[] home = new int[n], near = new int[n];
        long[] block = new long[n];
        double[] strength = new double[n], surety = new double[n], pull = new double[n], before = new double[n];
        boolean[] seen = new boolean[n];
        for (int i = 0; i < n; i++) {
            home[i] = i;
            surety[i] = -1.0;
            for (int j = starts[i]; j < starts[i + 1]; j++) strength[i] += weights[j];
        }
        double[] mass = (double[]) strength.clone();
        double drift = 0.0;
        long blocks = 0;
        int moves = n;
        while (moves > 0) {
            int size = Math.max(24, Math.min(1024, n / moves));
            moves = 0;
            for (int low = 0; low < n; low += size) {
                int high = Math.min(low + size, n);
                double past = drift, rise = 0.0, fall = 0.0;
                blocks++;
                for (int node = low; node < high; node++) {
                    if (surety[node] >= drift) continue;
                    int old = home[node], own = old, found = 0;
                    double k = strength[node], top = Double.NEGATIVE_INFINITY;
                    for (int j = starts[node]; j < starts[node + 1]; j++) {
                        if (others[j] == node) continue;
                        int c = home[others[j]];
                        if (!seen[c]) {
                            seen[c] = true;
                            near[found++] = c;
                            pull[c] = 0.0;
                        }
                        pull[c] += weights[j];
                    }
                    double best = (seen[old] ? pull[old] : 0.0) - (mass[old] - k) * k / total;
                    for (int j = 0; j < found; j++) {
                        int c = near[j];
                        seen[c] = false;
                        if (c == old) continue;
                        double gain = pull[c] - mass[c] * k / total;
                        if (gain > top) top = gain;
                    }
                    if (top <= best + 1e-12) {
                        surety[node] = past + Math.max(best - top - 1e-9, 0.0) * total / k / 2;
                        continue;
                    }
                    Arrays.sort(near, 0, found);
                    for (int j = 0; j < found; j++) {
                        int c = near[j];
                        if (c == old) continue;
                        double gain = pull[c] - mass[c] * k / total;
                        if (gain > best + 1e-12) {
                            own = c;
                            best = gain;
                        }
                    }
                    if (block[old] != blocks) {
                        block[old] = blocks;
                        before[old] = mass[old];
                    }
                    if (block[own] != blocks) {
                        block[own] = blocks;
                        before[own] = mass[own];
                    }
                    home[node] = own;
                    moves++;
                    mass[old] -= k;
                    mass[own] += k;
                    surety[node] = -1.0;
                    for (int j = starts[node]; j < starts[node + 1]; j++) surety[others[j]] = -1.0;
                    rise = Math.max(rise, mass[own] - before[own]);
                    fall = Math.max(fall, before[old] - mass[old]);
                    drift = past + rise + fall;
                }
            }
        }
        return home;
    }

    static byte[] bytes(int[] groups) {
        ByteBuffer out = ByteBuffer.allocate(4 * groups.length).order(ByteOrder.LITTLE_ENDIAN);
        out.asIntBuffer().put(groups);
        return out.array();
    }

    /** (starts, others) of directed links -> the smallest node of each node's strong component; one pass, explicit stacks. */
    static byte[] strong(int[] starts, int[] others) {
        int n = starts.length - 1, count = 0, opened = 0;
        int[] order = new int[n], low = new int[n], group = new int[n], next = new int[n], path = new int[n], open = new int[n];
        Arrays.fill(group, -1);
        for (int start = 0; start < n; start++) {
            if (order[start] > 0) continue;
            int depth = 1;
            path[0] = start;
            open[opened++] = start;
            order[start] = low[start] = ++count;
            next[start] = starts[start];
            while (depth > 0) {
                int node = path[depth - 1];
                if (next[node] < starts[node + 1]) {
                    int other = others[next[node]++];
                    if (order[other] == 0) {
                        path[depth++] = other;
                        open[opened++] = other;
                        order[other] = low[other] = ++count;
                        next[other] = starts[other];
                    } else if (group[other] < 0) {
                        low[node] = Math.min(low[node], order[other]);
                    }
                    continue;
                }
                depth--;
                if (depth > 0) low[path[depth - 1]] = Math.min(low[path[depth - 1]], low[node]);
                if (low[node] < order[node]) continue;
                int last = opened, least = node;
                do {
                    opened--;
                    least = Math.min(least, open[opened]);
                } while (open[opened] != node);
                for (int i = opened; i < last; i++) group[open[i]] = least;
            }
        }
        return bytes(group);
    }

    public Object call(Object a, Object b, Object c, Object d) {
        if (a == null) return null;
        int[] starts = ints((byte[]) a), others = ints((byte[]) b);
        if (c == null) return strong(starts, others);
        double[] weights = doubles((byte[]) c);
        double total = ((Number) d).doubleValue();
        int n = starts.length - 1;
        int[] groups = new int[n];
        for (int i = 0; i < n; i++) groups[i] = i;
        while (true) {
            int[] home = settled(n, starts, others, weights, total), names = new int[n], number = new int[n];
            Arrays.fill(number, -1);
            int kept = 0;
            for (int i = 0; i < n; i++) {
                if (number[home[i]] < 0) number[home[i]] = kept++;
                names[i] = number[home[i]];
            }
            for (int i = 0; i < groups.length; i++) groups[i] = names[groups[i]];
            if (kept == 1 || kept == n) break;
            int[] from = new int[kept + 1], place = new int[kept], members = new int[n];
            for (int i = 0; i < n; i++) from[names[i] + 1]++;
            for (int g = 0; g < kept; g++) {
                from[g + 1] += from[g];
                place[g] = from[g];
            }
            for (int i = 0; i < n; i++) members[place[names[i]]++] = i;
            int[] nextStarts = new int[kept + 1], nextOthers = new int[others.length], near = new int[kept];
            double[] nextWeights = new double[others.length], pull = new double[kept];
            boolean[] seen = new boolean[kept];
            int links = 0;
            for (int g = 0; g < kept; g++) {
                int found = 0;
                for (int m = from[g]; m < from[g + 1]; m++) {
                    for (int j = starts[members[m]]; j < starts[members[m] + 1]; j++) {
                        int other = names[others[j]];
                        if (!seen[other]) {
                            seen[other] = true;
                            near[found++] = other;
                            pull[other] = 0.0;
                        }
                        pull[other] += weights[j];
                    }
                }
                Arrays.sort(near, 0, found);
                for (int j = 0; j < found; j++) {
                    seen[near[j]] = false;
                    nextOthers[links] = near[j];
                    nextWeights[links++] = pull[near[j]];
                }
                nextStarts[g + 1] = links;
            }
            starts = nextStarts;
            others = nextOthers;
            weights = nextWeights;
            n = kept;
        }
        return bytes(groups);
    }
}
"""


def louvain(spark: SparkSession) -> Callable[..., Column] | None:
    """(starts, others, weights, total) -> groups as a function of columns; without weights, of directed links, -> the
    smallest node of each node's strong component. None where the session has no JVM at hand or doesn't take the jar."""
    context = getattr(spark, "_sc", None)
    if context is None:
        return None
    from pyspark.sql.classic.column import Column as Classic, _to_java_column, _to_seq  # absent from clients without a JVM

    if not hasattr(context, "_trellis_louvain"):
        try:
            context._trellis_louvain = _compiled(spark)
        except Exception:  # another compiler, or jars that may not be added: kernels.louvain does the same
            context._trellis_louvain = None
    made = context._trellis_louvain
    return made and (lambda *columns: Classic(made.apply(_to_seq(context, columns, _to_java_column))))


def _compiled(spark: SparkSession):
    context, jvm = spark.sparkContext, spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(LOUVAIN)
    classes = compiler.getBytecodes()
    jar = os.path.join(tempfile.mkdtemp(prefix="trellis-jar-"), "louvain.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name in classes.keySet():
            z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    context._jsc.addJar(jar)
    made = compiler.getClassLoader().loadClass("trellis.Louvain")
    instance = made.getDeclaredConstructor(context._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))
    return jvm.org.apache.spark.sql.functions.udf(instance, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
